"""Toxicity by a weighted lexicon that is matched by an Aho-Corasick automaton over folded text.

Texts are folded first: case, compatibility forms, accents of stray marks, homoglyphs of other scripts, digits and
signs standing for letters. Lexicon entries are words and word beginnings with log-odds weights; exception phrases
are words and pairs of words that contain an entry and speak for harmless text, and cancel the matches inside them.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import cut

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ε": "e", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
#: Digits and signs written for letters; they count only between or beside letters of a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
_HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_TABLE = str.maketrans(HOMOGLYPHS) | _HIDDEN
_MIXED = re.compile(r"[^\W_]*[013457-8@$!][\w@$!]*[^\W_]|[^\W\d_]+[013457-8@$!]+[\w@$!]*|[@$][^\W\d_]+")
_FOREIGN = re.compile("[" + "".join(map(chr, _TABLE)) + "]")
#: Where a word may be masked: a digit or sign before a word's character, or such a digit after a letter.
_MASKED = re.compile(r"[013457-8@$!]\w|[^\W\d_][013457-8]")
_BREAK = re.compile(r"[\W_]+")
_PLAIN = re.compile(r"[^\W\d_]")


def _unmask(m: re.Match) -> str:
    word = m[0]
    core = word.rstrip("!$@") if _PLAIN.search(word) else word
    if not _PLAIN.search(core):
        return word
    return core.translate(_DIGITS) + word[len(core) :]


_DIGITS = str.maketrans(SUBSTITUTES)


def fold(text: str | None) -> str:
    """Folded words with one blank before, between and after them; '' for texts without a word."""
    if not text:
        return ""
    t = text
    if not text.isascii():
        t = text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)
    t = t.lower()
    # Most texts need neither step; one look at the characters tells.
    if _FOREIGN.search(t):
        t = t.translate(_TABLE)
    if _MASKED.search(t):
        t = _MIXED.sub(_unmask, t)
    t = _BREAK.sub(" ", t).strip()
    return f" {t} " if t else ""


@dataclass(frozen=True)
class Lexicon:
    """Weights of entries (they begin with a blank, and end with one if a whole word is meant), exception phrases,
    and the curve from weight per length to score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    bias: float = -4.0
    slope: float = 1.0
    length_power: float = 0.25

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            out.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            out.add_word(phrase, (len(phrase), None))
        if len(out):
            out.make_automaton()
        return out


def weigh(folded: str, automaton: ahocorasick.Automaton) -> tuple[float, int]:
    """Sum of the weights of matches that stand in no exception phrase, one match (the weightiest) for each place
    where a word begins, and the number of words."""
    words = max(0, folded.count(" ") - 1)
    if not len(automaton) or not folded:
        return 0.0, words
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        if weight is None:
            spared.append((end - size + 1, end))
        else:
            start = end - size + 1
            best[start] = max(best.get(start, -math.inf), weight)
    if spared:
        covered = set().union(*(range(a, b) for a, b in spared))
        best = {k: w for k, w in best.items() if k not in covered}
    return sum(best.values()), words


def score(weight: float, words: int, lexicon: Lexicon) -> float:
    """Between 0 and 1: a logistic curve over the weight, divided by a power of the length in hundreds of words."""
    x = lexicon.bias + lexicon.slope * weight / max(1.0, words / 100) ** lexicon.length_power
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def _signature(folded: str) -> list[int]:
    """The four smallest hashes of five words in a row: texts that share two of them are taken for near copies."""
    words = folded.split()
    runs = {xxhash.xxh64_intdigest(" ".join(words[k : k + 5])) - (1 << 63) for k in range(max(1, len(words) - 4))}
    return sorted(runs)[:4]


def _one_of_each(rows: list[tuple[int, int, list[int]]]) -> list[int]:
    """Of rows (id, label, signature) the ids of one row of each group of near copies of a label, the smallest."""
    parent = {i: i for i, _, _ in rows}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[tuple, int] = {}
    for i, label, signature in rows:
        for pair in combinations(signature, 2) if len(signature) > 1 else [tuple(signature)]:
            a, b = root(i), root(seen.setdefault((label, pair), i))
            parent[max(a, b)] = min(a, b)
    return [i for i in parent if parent[i] == i]


def _features(words: set[str], lengths: tuple[int, ...]) -> set[str]:
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in lengths if len(w) >= k}


def _phrases(folded: str, automaton: ahocorasick.Automaton) -> set[str]:
    """Words in which an entry matches, alone and with the word before or after."""
    words = folded.split()
    starts = {k: i for i, k in enumerate(accumulate((len(w) + 1 for w in words[:-1]), initial=0))}
    out: set[str] = set()
    for end, (size, _) in automaton.iter(folded):
        i = starts[end - size + 1]
        out.add(f" {words[i]} ")
        out.update(f" {words[j]} {words[j + 1]} " for j in (i - 1, i) if 0 <= j < len(words) - 1)
    return out


def learn(
    texts: DataFrame, label: str = "label", text: str = "text", prefixes: tuple[int, ...] = (3, 4, 5, 6, 7, 8),
    min_docs: int = 4, min_weight: float = 1.5, min_evidence: float = 3.0, smooth: float = 0.5, harm: float = 5.0, common: float = 0.03,
) -> Lexicon:
    """A lexicon from a bounded sample of labelled rows (text, label 0 or 1); see `train` for the bound.

    Near copies of a sample count once. For each folded word and each word beginning of the lengths `prefixes` the
    documents of either label are counted by partial aggregates; those with `min_evidence` are looked up in each sample
    document, and entries are taken one by one, each the one that explains most toxic documents that no entry explains
    yet, less `harm` times the share of harmless ones, until none explains `min_docs` more. Whole words in a share of
    `common` of the toxic documents with a clear weight are entries as well.
    Weights are log-odds over the sample. Exceptions are words, and pairs of words, with an entry in them that stand in
    `min_docs` harmless documents and in no toxic one. Empty or one-sided samples give an empty lexicon. The same rows
    give the same lexicon, whatever their order.
    """

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "sig": [_signature(fold(t)) for t in batch["text"]]})

    def counter(features_of):
        def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found: Counter = Counter()
                for t, y in zip(batch["text"], batch["label"], strict=True):
                    found.update((f, y) for f in features_of(fold(t)))
                yield pd.DataFrame([(f, y, n) for (f, y), n in found.items()], columns=["feature", "label", "n"])

        of = lambda y: F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0))
        return sample.mapInPandas(counts, "feature string, label int, n long").groupBy("feature").agg(of(1).alias("pos"), of(0).alias("neg"))

    sample = texts.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    sample = cut(sample.distinct().withColumn("id", F.xxhash64("text", "label")))
    signatures = sample.mapInPandas(signed, "id long, label int, sig array<long>").collect()  # a few numbers for each row of the bounded sample
    kept = texts.sparkSession.createDataFrame([(i,) for i in _one_of_each([tuple(r) for r in signatures])], "kept long")
    sample = cut(sample.join(F.broadcast(kept), F.col("id") == F.col("kept")).select("text", "label"))
    total = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return Lexicon({})
    counted = cut(counter(lambda t: _features(set(t.split()), prefixes)).where(F.col("pos") >= min_docs))
    weight = F.log((F.col("pos") + smooth) / (n1 + 2 * smooth)) - F.log((F.col("neg") + smooth) / (n0 + 2 * smooth))
    # Evidence: standard deviations by which the toxic documents exceed those expected by chance.
    chance = (F.col("pos") + F.col("neg")) * (n1 / (n1 + n0))
    able = counted.select("feature", "pos", weight.alias("weight"), ((F.col("pos") - chance) / F.sqrt(chance)).alias("evidence"))
    rows = able.where((F.col("weight") >= min_weight) & (F.col("evidence") >= min_evidence)).orderBy(F.desc("evidence"), "feature").collect()
    names, weights = [r["feature"] for r in rows], [r["weight"] for r in rows]
    place = {f: k for k, f in enumerate(names)}

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted(place[f] for f in _features(set(fold(t).split()), prefixes) if f in place) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "found": found})

    seen = sample.mapInPandas(hits, "label int, found array<int>").where(F.size("found") > 0).collect()
    toxic = np.array([r["label"] == 1 for r in seen], bool)
    has = np.zeros((len(seen), len(names)), bool)
    for k, r in enumerate(seen):
        has[k, r["found"]] = True
    chosen: dict[str, float] = {}
    open_ = np.ones(len(seen), bool)
    least = max(min_docs, 0.002 * n1)
    while len(names):
        pos, neg = has[open_ & toxic].sum(0), has[open_ & ~toxic].sum(0)
        gain = np.where(pos >= least, pos / n1 - harm * neg / n0, -1.0)
        if gain.max() <= 0:
            break
        # Of features that explain about as much, the longest says best what is meant.
        k = max(np.nonzero(gain >= 0.97 * gain.max())[0].tolist(), key=lambda k: (names[k].endswith(" "), len(names[k]), names[k]))
        chosen[names[k]] = weights[k]
        open_ &= ~has[:, k]
    # Words that the entries so far explain along with others are entries too where they are frequent and clear.
    for f, w, r in zip(names, weights, rows, strict=True):
        if f.endswith(" ") and r["pos"] >= common * n1 and w >= min_weight + 2:
            chosen.setdefault(f, w)
    if not chosen:
        return Lexicon({})
    found: list = []

    def phrases(folded: str) -> set[str]:
        if not found:  # once in each Python worker
            found.append(Lexicon(chosen).automaton())
        return _phrases(folded, found[0])

    spare = counter(phrases).where((F.col("pos") == 0) & (F.col("neg") >= min_docs)).select("feature").collect()
    return Lexicon(chosen, tuple(sorted(r["feature"] for r in spare)))


def fit_curve(lexicon: Lexicon, rows: list[tuple[float, int, int]]) -> Lexicon:
    """Bias, slope and length power by logistic regression over (weight, words, label) of a bounded sample."""
    if not rows or len({y for _, _, y in rows}) < 2:
        return lexicon
    best = None
    for power in (0.1, 0.25, 0.5):
        xs = [w / max(1.0, n / 100) ** power for w, n, _ in rows]
        ys = [y for _, _, y in rows]
        a, b = -3.0, 1.0
        for _ in range(60):  # Newton steps with a small ridge
            g0 = g1 = h00 = h01 = h11 = 0.0
            for x, y in zip(xs, ys, strict=True):
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
                v = p * (1 - p)
                g0 += p - y
                g1 += (p - y) * x
                h00 += v
                h01 += v * x
                h11 += v * x * x
            g0, g1, h00, h11 = g0 + 1e-2 * a, g1 + 1e-2 * b, h00 + 1e-2, h11 + 1e-2
            d = h00 * h11 - h01 * h01
            da, db = (h11 * g0 - h01 * g1) / d, (h00 * g1 - h01 * g0) / d
            step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
            a, b = a - step * da, b - step * db
            if max(abs(da), abs(db)) < 1e-6:
                break
        loss = sum(math.log1p(math.exp(-max(-30.0, min(30.0, (a + b * x) * (1 if y else -1))))) for x, y in zip(xs, ys, strict=True))
        if b > 0 and (best is None or loss < best[0]):
            best = (loss, a, b, power)
    return lexicon if best is None else Lexicon(lexicon.weights, lexicon.exceptions, best[1], best[2], best[3])


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """`docs` with weight, n_folded_words and score, which replace columns of these names. Null and empty texts weigh 0
    and have the score of the bias."""
    @F.pandas_udf("weight double, n_folded_words long, score double")
    def go(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for t in texts:
            rows = [weigh(fold(x), automaton) for x in t]
            yield pd.DataFrame([(w, n, score(w, n, lexicon)) for w, n in rows], columns=["weight", "n_folded_words", "score"])

    rest = [c for c in docs.columns if c not in ("weight", "n_folded_words", "score")]
    return docs.select(*rest, go(F.col(text)).alias("__s")).select(*rest, "__s.*")


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 8000, seed: int = 11) -> Lexicon:
    """A lexicon and its curve from `labels` (doc_id, label) over `docs`.

    At most `max_rows` rows of either label are used, those with the smallest hashes of their ids, so a sample does
    not depend on the order of rows. They give the entries and then, by weight and length alone, the three numbers of
    the curve. The sample's ids are broadcast: their number is bounded by `max_rows`.
    """
    usable = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("__id").isNotNull())
    mixed = F.xxhash64("__id", F.lit(seed))
    halves = [usable.where(F.col("label") == y).select("__id", "label", mixed.alias("h")).orderBy("h", "__id").limit(max_rows) for y in (0, 1)]
    sample = halves[0].union(halves[1]).dropDuplicates(["__id"])
    rows = docs.select(F.col(doc_id).alias("__d"), F.col(text).alias("text")).join(F.broadcast(sample), F.col("__d") == F.col("__id")).select("text", "label", "h")
    rows = cut(rows)
    lexicon = learn(rows)
    curve = scored(rows, lexicon).select("weight", "n_folded_words", "label").collect()
    return fit_curve(lexicon, sorted(tuple(r) for r in curve))
