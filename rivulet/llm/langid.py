"""Language of web pages by Bayesian fusion of text, declared language, address suffix and host.

The text likelihood is a naive Bayes model over hashed character trigrams. What a page declares and the suffix of
its address are likelihoods counted over the corpus, weighted by the text's own verdicts. Hosts have priors that are
smoothed towards their domain's and those towards the corpus's, all by grouped sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import cut, let, unplaced
from rivulet.llm.htmltext import host_of, main_blocks, parse

_DECLARED = re.compile(r"(?is)<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,3})\b")
_META = re.compile(r"(?is)<meta\b[^>]*?(?:http-equiv\s*=\s*[\"']?content-language|property\s*=\s*[\"']?og:locale)[\"']?[^>]*?content\s*=\s*[\"']?\s*([a-z]{2,3})\b")
_BLOCK = 1 << 16
#: Second levels under country codes that many owners share.
SECOND_LEVELS = tuple("ac co com edu gob gouv gov go gv ind info ltd mil ne net nom nic or org plc sch".split())


def trigrams(text: str, size: int) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's character trigrams, in slices; case is folded and runs of other than letters are blanks."""
    letters = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    points = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for at in range(0, max(0, len(points) - 2), _BLOCK):
        p = points[at : at + _BLOCK + 2]
        mixed = (p[:-2] * np.uint64(0x9E3779B1) + p[1:-1]) * np.uint64(0x85EBCA77) + p[2:]
        yield ((mixed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)).astype(np.int64) % size


@dataclass(frozen=True)
class TextModel:
    """Log-probabilities of trigram buckets, one row for each of `languages`."""

    languages: tuple[str, ...]
    log_p: np.ndarray

    def loglik(self, text: str) -> tuple[np.ndarray, int]:
        out, n = np.zeros(len(self.languages)), 0
        for index in trigrams(text, self.log_p.shape[1]):
            out += self.log_p[:, index].sum(axis=1, dtype=np.float64)
            n += len(index)
        return out, n


def train(docs: DataFrame, lang: str = "lang", text: str = "text", max_docs: int = 1000, size: int = 1 << 15, smooth: float = 0.5, seed: int = 5) -> TextModel:
    """A text model from labelled documents: of each language all, or if it has more a sample of about `max_docs`.

    The sample is the texts whose hashes lie in the share of all hashes that `max_docs` is of the language's rows, so one
    count finds it and copies are in or out together (one of them is used). Whole texts are counted on the executors; the
    driver gets at most `size` counts for each language. Rows without a language or text are left out; a corpus
    without labels gives a model of no language.
    """
    usable = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    rows = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    names = sorted(rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, texts in batch.groupby("lang")["text"]:
                found = np.zeros(size, np.int64)
                for t in texts:
                    for index in trigrams(t, size):
                        found += np.bincount(index, minlength=size)
                at = np.nonzero(found)[0]
                yield pd.DataFrame({"lang": name, "bucket": at, "n": found[at]})

    counts = np.full((len(names), size), smooth)
    if names:
        share = F.coalesce(*[F.when(F.col("lang") == n, min(1.0, max_docs / rows[n])) for n in names])
        # A hash's top 53 bits as a number between 0 and 1.
        hashed = usable.withColumn("h", F.xxhash64("text", F.lit(seed)))
        sample = hashed.where(F.shiftrightunsigned("h", 11) / float(1 << 53) < share).dropDuplicates(["lang", "h"])
        for r in sample.select("lang", "text").mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
            counts[names.index(r["lang"]), r["bucket"]] += r["n"]
    return TextModel(tuple(names), np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def evidence(pages: DataFrame, model: TextModel, temper: float = 0.3, most: float = 40.0) -> DataFrame:
    """Rows (page_id, url, host, domain, suffix, declared, loglik): what each page shows.

    loglik is relative to the best language; trigrams overlap and are no independent witnesses, so it is tempered,
    and it is held to `most`. Pages without text have equal likelihoods. declared is null where nothing is declared.
    """

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            declared, likely = [], []
            for h in batch["html"]:
                found = h and (_DECLARED.search(h) or _META.search(h))
                declared.append(found[1].lower() if found else None)
                out, _ = model.loglik("\n".join(main_blocks(parse(h), frozenset())))
                likely.append(np.maximum(temper * (out - out.max(initial=-np.inf)), -most))
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "host": batch["host"], "domain": batch["domain"], "suffix": batch["suffix"], "declared": declared, "loglik": likely})

    name = host_of()
    labels = F.split(name, "\\.")
    # Under a country's generic second level a domain has three labels.
    second = F.get(labels, F.size(labels) - 2)
    long = F.coalesce((F.length(F.element_at(labels, -1)) == 2) & second.isin(*SECOND_LEVELS), F.lit(False))
    n = F.least(F.size(labels), F.when(long, 3).otherwise(2))
    domain = F.concat_ws(".", F.slice(labels, F.size(labels) - n + 1, n))
    base = pages.select("page_id", "url", "html", F.xxhash64(name).alias("host"), F.xxhash64(domain).alias("domain"), F.element_at(labels, -1).alias("suffix"))
    return base.mapInPandas(show, "page_id long, url string, host long, domain long, suffix string, declared string, loglik array<double>")


def _softmax(logits: Column) -> Column:
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    powers = lambda l: let(F.array_max(l), lambda top: F.transform(l, lambda x: F.exp(x - top)))
    return let(logits, lambda l: let(powers(l), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s))))


def identify(pages: DataFrame, model: TextModel, strength: float = 10.0, smooth: float = 1.0) -> DataFrame:
    """Rows (page_id, url, declared, text_lang, lang, posterior), one for each row of `pages`.

    lang is the language with the largest posterior, text_lang that with the largest text likelihood; ties go to the
    first name. A page's own share is taken out of its host's counts. `strength` is the weight, in pages, of a
    domain's prior in its hosts' and of the corpus's in the domains'. Repeated rows are pages of their own. Empty and null pages go by what is declared and
    by their host. A model of no language gives null languages.
    """
    k = len(model.languages)
    if not k:
        null = F.lit(None).cast("string")
        return pages.select("page_id", "url", null.alias("declared"), null.alias("text_lang"), null.alias("lang"), F.lit(None).cast("double").alias("posterior"))
    seen = cut(evidence(pages, model).withColumn("p", _softmax(F.col("loglik"))))
    sums = [F.sum(F.get("p", i)).alias(f"s{i}") for i in range(k)]
    total = seen.agg(*sums).first()
    total = [max(0.0, x or 0.0) for x in total]
    corpus = [(x + smooth) / (sum(total) + smooth * k) for x in total]

    def prior(own: list[Column], above: list[Column]) -> list[Column]:
        n = sum(own[1:], own[0])
        return [(own[i] + strength * above[i]) / (n + strength) for i in range(k)]

    domains = seen.groupBy("domain").agg(*sums)
    domains = domains.select("domain", F.array(*prior([F.col(f"s{i}") for i in range(k)], [F.lit(c) for c in corpus])).alias("above"))
    hosts = seen.groupBy("host", "domain").agg(F.array(*sums).alias("own"))
    hosts = cut(unplaced(hosts, "domain").join(unplaced(domains, "domain"), "domain").select(F.col("host").alias("h"), "own", "above"))

    def likelihood(column: str) -> DataFrame:
        """For each value of `column`, log P(value | language) less that of a value never seen."""
        values = seen.where(F.col(column).isNotNull()).groupBy(column).agg(*sums)
        # Laplace's rule over the values that there are and one that was never seen.
        n = values.count() + 1
        return values.select(F.col(column).alias(f"_{column}"), F.array(*[F.log((F.col(f"s{i}") + smooth) / (total[i] + smooth * n)) for i in range(k)]).alias(f"{column}_log"))

    # Declared languages have three letters at most, suffixes are the last labels of names; both tables are small, yet
    # joined as any other, with both sides exchanged, unless found small enough at run time.
    out = seen.join(likelihood("declared"), F.col("declared") == F.col("_declared"), "left")
    out = out.join(likelihood("suffix"), F.col("suffix") == F.col("_suffix"), "left")
    out = unplaced(out, "host").join(unplaced(hosts, "h"), F.col("host") == F.col("h"))
    rest = [F.greatest(F.lit(0.0), F.get("own", i) - F.get("p", i)) for i in range(k)]
    at_host = prior(rest, [F.get("above", i) for i in range(k)])
    none = F.lit(0.0)
    logits = F.array(*[F.get("loglik", i) + F.coalesce(F.get("declared_log", i), none) + F.coalesce(F.get("suffix_log", i), none) + F.log(at_host[i]) for i in range(k)])
    names = F.array(*[F.lit(n) for n in model.languages])
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    out = out.withColumn("post", _softmax(logits))
    return out.select("page_id", "url", "declared", best(F.col("loglik")).alias("text_lang"), best(F.col("post")).alias("lang"), F.round(F.array_max("post"), 6).alias("posterior"))
