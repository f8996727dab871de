"""SimHash near-duplicates of whole texts: Golay keys propose pairs, exact sets of shingles decide.

Texts whose sets of shingles agree by 0.8 differ in too many bits of a shingle fingerprint for any key. Fingerprints
over a text's words, weighted by the logarithm of their number, differ in few, so several of those give the keys.

What is proposed is thinned out before it is verified, without loss: a text also carries the parities of its shingles
in a row of bits, and two sets differ in at least as many shingles as their parities differ in bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import WS, WS_CLASS, cut, lower_ascii, release, unplaced
from rivulet.llm.components import components
from rivulet.llm.simhash import candidate_keys

_U = np.uint64
_WORDS_AT_ONCE = 1 << 16
#: Bits of a tag that are a fingerprint.
_SKETCH = 40


class _Hashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str | None, known: _Hashes) -> np.ndarray:
    """A hash for each word in turn; A-Z lower-cased, words are runs of other than [\\x20\\x09-\\x0D]."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(known.__getitem__, words), _U, len(words))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; fewer words are one shingle, no words one of their own."""
    n = max(1, len(words) - width + 1)
    h = np.full(n, min(width, len(words)), _U)
    for k in range(min(width, len(words))):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(h)


def word_fingerprints(words: np.ndarray, tables: int) -> np.ndarray:
    """`tables` fingerprints: each bit the majority of the words' hashes, a word that stands n times weighing 1 + ln n."""
    distinct, times = np.unique(words, return_counts=True)
    weights = np.rint(64 * (1 + np.log(times))).astype(np.int64)
    votes = np.zeros((tables, 64), np.int64)
    for at in range(0, len(distinct), _WORDS_AT_ONCE):
        some, w = distinct[at : at + _WORDS_AT_ONCE], weights[at : at + _WORDS_AT_ONCE]
        for t in range(tables):
            bits = np.unpackbits(_mix(some + _U(0x9E3779B97F4A7C15 * (t + 1) % 2**64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            # Below 2**53, so that sums of doubles are exact.
            votes[t] += (w.astype(np.float64) @ bits).astype(np.int64)
    return np.packbits(votes * 2 > weights.sum(), axis=1, bitorder="little").view("<u8")[:, 0]


def parity_bits(n: int) -> int:
    """Bits of the parities of n shingles: two to four for each up to 8,192, beyond that one or two for each."""
    return max(256, min(8192, 1 << (2 * n - 1).bit_length()), 1 << (n - 1).bit_length())


def parities(of: np.ndarray) -> bytes:
    """For each place whether an odd number of the shingles falls there. Folding the halves gives half as many bits."""
    size = parity_bits(len(of))
    return np.packbits(np.bincount((of & _U(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def _able(differing: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of together `sizes` members, of which at least `differing` are in one alone, may agree by `least`."""
    return differing * (1 + least) <= sizes * (1 - least) + 1e-9


def near_in_block(x: list[bytes], y: list[bytes], nx: np.ndarray, ny: np.ndarray, least: float) -> np.ndarray:
    """(len(x), len(y)) shares by which parities and sizes allow the sets to agree; 0 where that is below `least`."""
    out = np.zeros((len(x), len(y)))
    sx, sy = np.array([len(b) for b in x]), np.array([len(b) for b in y])
    for kx in np.unique(sx):
        for ky in np.unique(sy):
            rx, ry = np.flatnonzero(sx == kx), np.flatnonzero(sy == ky)
            if max(nx[rx].min(), ny[ry].min()) * least > min(nx[rx].max(), ny[ry].max()):
                continue
            bits = []
            for some, rows, k in ((x, rx, kx), (y, ry, ky)):
                m = np.frombuffer(b"".join(some[r] for r in rows), _U).reshape(len(rows), -1)
                while k > min(kx, ky):
                    m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
                    k //= 2
                bits.append(m)
            step = max(1, (1 << 22) // max(1, bits[1].size))
            for at in range(0, len(rx), step):
                a = bits[0][at : at + step]
                d = np.bitwise_count(a[:, None, :] ^ bits[1][None, :, :]).sum(axis=2, dtype=np.int64)
                p, q = nx[rx[at : at + step]][:, None], ny[ry][None, :]
                # No fewer differ than the sizes do.
                d = np.maximum(d, np.abs(p - q))
                out[np.ix_(rx[at : at + step], ry)] = np.where(_able(d, p + q, least), np.maximum(1 - 2 * d / np.maximum(p + q + d, 1), 1e-9), 0.0)
    return out


def _pairs(a: Column, b: Column, rows: DataFrame) -> DataFrame:
    """Each unordered pair once."""
    return rows.where(a != b).groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.lit(1).alias("__one")).select("a", "b")


def _with(rows: DataFrame, of: str, table: DataFrame, *names: str) -> DataFrame:
    """`rows` with columns of `table` (node, ...) for the node in column `of`, named with its name behind."""
    known = unplaced(table.select(F.col("node").alias("__n"), *[F.col(c).alias(f"{c}_{of}") for c in names]), "__n")
    return unplaced(rows, of).join(known, F.col(of) == F.col("__n")).drop("__n")


def _labelled(table: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """`table` with the component of each node as `name`; a node without one is its own."""
    known = unplaced(labels.select(F.col("node").alias("__n"), F.col("component").alias("__c")), "__n")
    return unplaced(table, "node").join(known, F.col("node") == F.col("__n"), "left").withColumn(name, F.coalesce("__c", "node")).drop("__n", "__c")


class _Search:
    """The groups of a table of nodes (node, n: shingles, fps, bits: parities, tag), all of them different texts.

    A tag is a node's name while keys are compared: 40 bits of one more fingerprint and 24 bits of a hash. Two tags tell
    at once whether their texts may be near, without a look at the texts' rows.
    """

    def __init__(self, nodes: DataFrame, sets_of, least: float, tables: int, far: int, few: int, block: int):
        self.nodes, self.sets_of, self.least, self.tables, self.few, self.block = nodes, sets_of, least, tables, few, block
        self.far, self.far_tags = far * tables, far * _SKETCH // 64 + 1

    def keyed(self, nodes: DataFrame) -> DataFrame:
        """Rows (key, tag, g) of `nodes` (tag, fps, g)."""
        tables = self.tables

        def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                tag, g, fps = batch["tag"].to_numpy(np.int64), batch["g"].to_numpy(np.int64), np.array(batch["fps"].tolist(), np.int64).reshape(len(batch), -1)
                for at in range(0, len(tag), 1024):
                    for k in range(tables):
                        rows, keys = candidate_keys(np.ascontiguousarray(fps[at : at + 1024, k]).view(np.uint64))
                        yield pd.DataFrame({"key": keys << 3 | k, "tag": tag[at : at + 1024][rows], "g": g[at : at + 1024][rows]})

        return nodes.select("tag", "fps", "g").mapInPandas(expand, "key long, tag long, g long")

    def tags_near(self, a: Column, b: Column) -> Column:
        return F.bit_count(F.shiftrightunsigned(a.bitwiseXOR(b), 64 - _SKETCH)) <= self.far_tags

    def near(self, tags: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes with the tags of a row (a, b) whose fingerprints differ in few enough bits."""
        known = unplaced(self.nodes.select("tag", "node", "fps"), "tag")
        for c in ("a", "b"):
            tags = unplaced(tags, c).join(known.select(F.col("tag").alias(f"t{c}"), F.col("node").alias(f"node_{c}"), F.col("fps").alias(f"fps_{c}")), F.col(c) == F.col(f"t{c}"))
        return _pairs(F.col("node_a"), F.col("node_b"), tags.where(self.bits("fps_a", "fps_b") <= self.far))

    @staticmethod
    def bits(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)

    def able(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes and parities allow to be similar."""
        least = self.least

        @F.pandas_udf("boolean")
        def go(x: pd.Series, y: pd.Series, nx: pd.Series, ny: pd.Series) -> pd.Series:
            return pd.Series([near_in_block([a], [b], np.array([p]), np.array([q]), least)[0, 0] > 0 for a, b, p, q in zip(x, y, nx, ny, strict=True)], dtype=bool)

        sized = _with(_with(pairs, "a", self.nodes, "n", "bits"), "b", self.nodes, "n", "bits")
        sized = sized.where(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))
        return sized.where(go("bits_a", "bits_b", "n_a", "n_b")).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets of shingles agree by `least`."""
        pairs = cut(pairs)
        sets = self.sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        both = _with(_with(pairs, "a", sets, "s"), "b", sets, "s")
        shared = F.size(F.array_intersect("s_a", "s_b"))
        out = cut(both.where(shared >= self.least * (F.size("s_a") + F.size("s_b") - shared)).select("a", "b"))
        release(out.sparkSession)
        return out

    def in_blocks(self, members: DataFrame, all_of_them: bool) -> DataFrame:
        """Pairs (a, b) to verify, of nodes of one neighbourhood g in different components c.

        `members` has (g, node, c, odd); only pairs with an odd node are looked at, which leaves out those inside the
        largest component alone. With `all_of_them` every pair that sizes and parities allow, else of each odd node the
        likeliest one in each block. Odd nodes and all nodes are dealt into blocks of about `block` nodes, and each
        pair of blocks is a task of its own.
        """
        least, block = self.least, self.block
        full = _with(members, "node", self.nodes, "n", "bits").select("g", "node", "c", "odd", F.col("n_node").alias("n"), F.col("bits_node").alias("bits"))

        def parts(of: Column) -> Column:
            n = F.greatest(F.ceil(F.sum(of) / block), F.ceil(F.sum(of * F.octet_length("bits")) / (block * 1024)))
            return F.greatest(n, F.lit(1)).cast("int")

        sizes = full.groupBy("g").agg(parts(F.col("odd").cast("long")).alias("nx"), parts(F.lit(1)).alias("ny")).select(F.col("g").alias("k"), "nx", "ny")
        dealt = cut(unplaced(full, "g").join(unplaced(sizes, "k"), F.col("g") == F.col("k")))
        own = F.xxhash64("node", F.lit(3))
        what = ["g", "node", "c", "n", "bits"]
        x = dealt.where("odd").select(*what, F.lit(True).alias("left"), F.pmod(own, F.col("nx")).cast("int").alias("bx"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("by"))
        y = dealt.select(*what, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("bx"), F.pmod(own, F.col("ny")).cast("int").alias("by"))

        def compare(rows: pd.DataFrame) -> pd.DataFrame:
            left = rows["left"].to_numpy(bool)
            if not left.any() or left.all():
                return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
            node, c, n, bits = (rows[k].to_numpy() for k in ("node", "c", "n", "bits"))
            share = near_in_block(list(bits[left]), list(bits[~left]), n[left], n[~left], least)
            share[c[left][:, None] == c[~left][None, :]] = 0
            if not all_of_them:
                top = share.argmax(axis=1)
                best = np.zeros_like(share)
                best[np.arange(len(top)), top] = share[np.arange(len(top)), top]
                share = best
            i, j = np.nonzero(share)
            return pd.DataFrame({"a": node[left][i].astype(np.int64), "b": node[~left][j].astype(np.int64)})

        # Rows placed by g alone would bring all blocks of a group to one task.
        found = unplaced(x.union(y), "g").groupBy("g", "bx", "by").applyInPandas(compare, "a long, b long")
        return _pairs(F.col("a"), F.col("b"), found)

    def mixed(self, around: DataFrame, links: DataFrame) -> DataFrame:
        """Rows (g, node, c, odd) of the neighbourhoods that hold several components; odd: outside the largest."""
        nodes = cut(_labelled(around, components(links), "c").select("g", "node", "c"))
        sizes = nodes.groupBy("g", "c").agg(F.count("*").alias("m"))
        mixed = sizes.groupBy("g").agg(F.max(F.struct("m", "c"))["c"].alias("main"), F.count("*").alias("parts")).where(F.col("parts") > 1)
        mixed = mixed.select(F.col("g").alias("k"), "main")
        members = unplaced(nodes, "g").join(unplaced(mixed, "k"), F.col("g") == F.col("k"))
        return cut(members.select("g", "node", "c", (F.col("c") != F.col("main")).alias("odd")))

    def _sent(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows of a few longs to be joined with all keyed rows: broadcast where they are few, else exchanged."""
        return F.broadcast(rows) if rows.count() <= self.few else unplaced(rows, key)

    @staticmethod
    def _some_ties(near: DataFrame) -> DataFrame:
        """Of each node's near pairs those with its smallest and its largest fellow: enough for neighbourhoods."""
        either = near.union(near.select("b", "a"))
        return either.groupBy("a").agg(F.min("b").alias("x"), F.max("b").alias("y")).select("a", F.explode(F.array("x", "y")).alias("b"))

    def groups(self) -> DataFrame:
        """Rows (node, component) for the nodes that link with another one.

        1. Keys are shuffled once, and only their smallest and largest tag, exclusive-or and number come out. That names
           all nodes of a key of two or three; their pairs are verified where they are near. The near ones tie nodes
           into neighbourhoods, as do the smallest and the largest node of a larger key.
        2. The other nodes of larger keys that are in another neighbourhood than the smallest one are strays. If there
           are many, as in large groups, they meet the smallest node first, and near ones tie.
        3. Strays meet all nodes of the key that are not in their own neighbourhood; near pairs are verified.
        4. In neighbourhoods that hold several components, first the likeliest pair of each node outside the largest
           one, then all pairs that are left are looked at in blocks, by their parities, and verified.

        So two similar texts that share a key are in one component, if their fingerprints are near at all; and no more
        rows come out of a key than it has nodes, but for near pairs of strays.
        """
        alone = self.nodes.withColumn("g", F.col("node"))
        keyed = self.keyed(alone)
        ends = cut(keyed.groupBy("key").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi"), F.bit_xor("tag").alias("x"), F.count("*").alias("m")).where(F.col("lo") != F.col("hi")))
        third = F.col("x").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
        pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        both = pair(F.col("lo"), F.col("hi"))
        three = F.array(both, pair(F.col("lo"), third), pair(third, F.col("hi")))
        met = ends.select(F.explode(F.when(F.col("m") == 3, three).otherwise(F.array(both))).alias("p")).select("p.a", "p.b")
        # Nodes with one tag are near by their sketches; keys cannot tell them apart.
        same = self.nodes.groupBy("tag").agg(F.count("*").alias("m")).where(F.col("m") > 1).select(F.col("tag").alias("a"), F.col("tag").alias("b"))
        near = cut(self.near(_pairs(F.col("a"), F.col("b"), met.where(self.tags_near(F.col("a"), F.col("b")))).union(same)))
        release(near.sparkSession)
        around = cut(components(self._some_ties(near)).select("node", F.col("component").alias("g")))

        crowded = ends.where(F.col("m") > 3).select("key", "lo")
        if crowded.limit(1).count():
            here, big = self.placed(around, crowded)
            away = (F.col("key") == F.col("k")) & (F.col("g") != F.col("glo"))
            strays = cut(self.keyed(here).join(self._sent(big, "k"), away))
            if strays.limit(self.few + 1).count() > self.few:
                met = strays.where(self.tags_near(F.col("tag"), F.col("lo")))
                near = cut(near.union(self.near(_pairs(F.col("tag"), F.col("lo"), met))))
                around = cut(components(self._some_ties(near)).select("node", F.col("component").alias("g")))
                here, big = self.placed(around, crowded)
                strays = cut(self.keyed(here).join(self._sent(big, "k"), away))
            strays = strays.select(F.col("key").alias("sk"), F.col("tag").alias("stray"), F.col("g").alias("sg"))
            met = self.keyed(here).join(self._sent(strays, "sk"), (F.col("key") == F.col("sk")) & (F.col("g") != F.col("sg")) & self.tags_near(F.col("tag"), F.col("stray")))
            near = cut(near.union(self.near(_pairs(F.col("tag"), F.col("stray"), met))))
            release(near.sparkSession)

        links = self.verified(self.able(near))
        for every in (False, True):
            members = self.mixed(around, links)
            links = cut(links.union(self.verified(self.in_blocks(members, every))))
        return components(links)

    def placed(self, around: DataFrame, crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The nodes (tag, fps, g) with their neighbourhoods, and rows (k, lo, glo) of the larger keys."""
        here = cut(_labelled(self.nodes.select("node", "tag", "fps"), around.withColumnRenamed("g", "component"), "g").select("tag", "fps", "g"))
        # Nodes that share a tag may be in different neighbourhoods; any one of them will do.
        of = here.groupBy("tag").agg(F.min("g").alias("glo"))
        big = unplaced(crowded, "lo").join(unplaced(of, "tag"), F.col("lo") == F.col("tag"))
        return here, cut(big.select(F.col("key").alias("k"), "lo", "glo"))


def text_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, least: float = 0.8,
    tables: int = 5, far_bits: int = 16, few: int = 1_000_000, block: int = 512,
) -> DataFrame:
    """Rows (doc_id, th, kept), one for each distinct pair of id and text hash: kept for one row of each group.

    Texts are grouped whose sets of `width`-word shingles, A-Z lower-cased, have a Jaccard similarity of `least` or
    more, directly or over others. Proposed are texts that share a Golay key of one of `tables` SimHash fingerprints
    and whose fingerprints differ in at most `far_bits` bits on average (those of strangers differ in 32); see
    `_Search.groups` for how a key's texts meet, and the README for the share of similar texts that share no key.
    Equal texts are one node from the start, so a large group of copies costs no comparison. Of a group the row with
    the smallest (doc_id, th) is kept, null ids last. Null, empty and blank texts are equal to each other. Other
    columns of `docs` are not looked at. Tables of two or three longs a row are broadcast where they have at most `few`
    rows, counted first.
    """
    if not 1 <= tables <= 8:
        raise ValueError("tables must be from 1 to 8")
    same = F.xxhash64(lower_ascii(F.regexp_replace(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(WS)), WS_CLASS + "+", " ")))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("th"), same.alias("node"), F.col(text).alias("text"))

    @F.pandas_udf("n int, fps array<long>, sketch long, bits binary")
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for t in texts:
            rows = []
            for x in t:
                words = word_hashes(x, known)
                s = shingles(words, width)
                fps = word_fingerprints(words, tables + 1).view(np.int64)
                rows.append((len(s), fps[:-1], fps[-1], parities(s)))
            yield pd.DataFrame(rows, columns=["n", "fps", "sketch", "bits"])

    own = cut(base.select("doc_id", "th", "node", features("text").alias("f")).select("doc_id", "th", "node", "f.*"))
    nodes = own.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "fps", "sketch", "bits")])
    tag = F.shiftleft("sketch", 64 - _SKETCH).bitwiseOR(F.col("node").bitwiseAND(F.lit((1 << (64 - _SKETCH)) - 1)))
    nodes = cut(nodes.select("node", "n", "fps", "bits", tag.alias("tag")))

    def sets_of(wanted: DataFrame) -> DataFrame:
        one = own.groupBy("node").agg(F.min(F.struct("th", "doc_id")).alias("r")).select(F.col("node").alias("m"), F.col("r.th").alias("rt"), F.col("r.doc_id").alias("rd"))
        picked = cut(unplaced(wanted, "node").join(unplaced(one, "m"), F.col("node") == F.col("m")).select("node", "rt", "rd"))

        @F.pandas_udf("array<long>")
        def sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known = _Hashes()
            for t in texts:
                yield pd.Series([shingles(word_hashes(x, known), width).view(np.int64) for x in t])

        # Few rows of 24 bytes are sent to the texts; many meet them by exchange.
        picked = F.broadcast(picked) if picked.count() <= few else unplaced(picked, "rt")
        found = unplaced(base.select("doc_id", "th", "text"), "th").join(picked, (F.col("rt") == F.col("th")) & F.col("rd").eqNullSafe(F.col("doc_id")))
        return cut(found.select("node", sets("text").alias("s")).groupBy("node").agg(F.first("s").alias("s")))

    found = _Search(nodes, sets_of, least, tables, far_bits, few, block).groups()
    grouped = cut(_labelled(own.select("doc_id", "th", "node").distinct(), found, "g").select("doc_id", "th", "g"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    first = grouped.groupBy("g").agg(F.min(order).alias("f")).select(F.col("g").alias("k"), "f")
    out = unplaced(grouped, "g").join(unplaced(first, "k"), F.col("g") == F.col("k"))
    return out.select("doc_id", "th", (F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("th") == F.col("f.th"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """`docs`, all its columns, with one row of each group of `text_groups`."""
    kept = text_groups(docs, text, doc_id, **options).where("kept").select(F.col("doc_id").alias("__kid"), F.col("th").alias("__kth"))
    both = docs.withColumn("__th", F.xxhash64(doc_id, text)).join(kept, F.col(doc_id).eqNullSafe(F.col("__kid")) & (F.col("__th") == F.col("__kth")))
    return both.dropDuplicates(["__kid", "__kth"]).select(*docs.columns)
