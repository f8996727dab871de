"""SimHash near-duplicates found through Golay-code keys.

A 64-bit fingerprint is a majority vote over shingle hashes. Candidates for at most three differing bits come
from keys: one of four 16-bit quarters must be equal; the other 48 bits form two halves with at most three errors
between them, so one half has at most one. Such a half, as a 23-bit word, is decoded to indices of Golay
codewords so that words one bit apart share an index.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import cut, unplaced
from rivulet.llm.components import components

_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint: bit b is set if over half of the shingles' XXH64 have it.

    A-Z are lower-cased, words are runs of other than [\\x20\\x09-\\x0D]; a text of fewer than `width` words is one
    shingle, a text without words has fingerprint 0. Works in slices, so memory follows the text alone.
    """
    # bytes.lower() and bytes.split() know exactly A-Z and exactly this white space.
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n], ends[min(width, len(words)) - 1 :]
    votes = np.zeros(64, np.int64)
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    for at in range(0, n, _SHINGLES_AT_ONCE):
        some = [digest(view[s:e], seed) for s, e in zip(starts[at : at + _SHINGLES_AT_ONCE].tolist(), ends[at : at + _SHINGLES_AT_ONCE].tolist(), strict=True)]
        votes += _bit_counts(np.array(some, "<u8"))
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def _bit_counts(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """`docs` with a column fp: the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(np.array([fingerprint(x, width) for x in t], np.uint64).view(np.int64))

    return docs.withColumn("fp", fp(F.col(text)))


# Fixed value: a generator polynomial of the binary Golay code of length 23, a perfect code: each 23-bit word has
# exactly one codeword within three bits.
_GOLAY = 0b101011100011
_LENGTH, _PARITY = 23, 11


@functools.cache
def _coset_patterns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and each syndrome's error patterns as (2048, 6), padded with -1.

    Words of a coset whose lightest pattern has at most two bits have this one pattern. Where it has three bits, the
    five patterns of four bits are added. Words one bit apart then share a codeword: moving one bit takes a word from
    distance three of a codeword to distance four at most, and a word at distance four of one is three from another.
    """
    def syndrome(x: int) -> int:
        for b in range(_LENGTH - 1, _PARITY - 1, -1):
            if x >> b & 1:
                x ^= _GOLAY << (b - _PARITY)
        return x

    of_bit = np.array([syndrome(1 << b) for b in range(_LENGTH)], np.int32)
    patterns: list[list[int]] = [[] for _ in range(1 << _PARITY)]
    for weight in range(5):
        for bits in itertools.combinations(range(_LENGTH), weight):
            own = patterns[functools.reduce(lambda s, b: s ^ int(of_bit[b]), bits, 0)]
            if not own or weight == 4 and own[0].bit_count() == 3:
                own.append(sum(1 << b for b in bits))
    out = np.full((1 << _PARITY, 6), -1, np.int32)
    for k, own in enumerate(patterns):
        out[k, : len(own)] = own
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for b in range(_LENGTH):
        part, at = (low, b) if b < 12 else (high, b - 12)
        part[(np.arange(len(part)) >> at & 1) == 1] ^= of_bit[b]
    return low, high, out


def codeword_indices(v: np.ndarray) -> np.ndarray:
    """For 23-bit words the (n, 6) indices of their codewords (the message bits), padded with -1."""
    low, high, patterns = _coset_patterns()
    p = patterns[low[v & 0xFFF] ^ high[v >> 12]]
    return np.where(p < 0, -1, (v[:, None] ^ p) >> _PARITY)


def candidate_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: two fingerprints at most three bits apart share a key.

    A key holds the number of the exact quarter and its 16 bits, the number of the half and a codeword index.
    """
    rows, keys = [], []
    v = fp.astype(np.uint64)
    for quarter in range(4):
        turned = v if quarter == 0 else (v >> np.uint64(16 * quarter)) | (v << np.uint64(64 - 16 * quarter))
        exact = (turned & np.uint64(0xFFFF)).astype(np.int64)
        for half in range(2):
            part = (turned >> np.uint64(16 + 24 * half)) & np.uint64(0x7FFFFF)
            index = codeword_indices(part.astype(np.int64))
            at, which = np.nonzero(index >= 0)
            rows.append(at)
            keys.append(((exact[at] << 3 | quarter << 1 | half) << 12) | index[at, which])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = batch["fp"].to_numpy(np.int64)
            for at in range(0, len(v), 4096):
                rows, keys = candidate_keys(v[at : at + 4096].view(np.uint64))
                yield pd.DataFrame({"key": keys, "fp": v[at : at + 4096][rows]})

    return fps.select("fp").mapInPandas(expand, "key long, fp long")


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def linked_components(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Rows (fp, component) for the distinct fingerprints in `fps` that link with another one.

    component is one fingerprint of the set of those reachable over links of at most `max_bits` (three is the most
    that the keys promise). All links count, yet pairs within a key are never listed: each fingerprint is first
    verified against the smallest and the largest of its key, which joins nearly all of a group of copies; only
    fingerprints still in another component than their key's smallest are then compared with the rest of the key.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys find links of at most 3 bits")
    # Spark takes an expanded table to be as large as what it came from; cut rows have no estimate to go by.
    keyed = _keyed(cut(fps.select("fp")))
    ends = keyed.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where(F.col("lo") != F.col("hi"))
    shared = cut(keyed.join(unplaced(ends, "key"), "key").select("key", "fp", "lo", "hi"))
    stars = F.array(F.col("lo"), F.col("hi"))
    found = shared.select("fp", F.explode(F.filter(stars, lambda x: (x != F.col("fp")) & (_differing(x, F.col("fp")) <= max_bits))).alias("other"))
    first = components(found, "fp", "other").select(F.col("node").alias("n"), F.col("component").alias("c"))
    placed = unplaced(shared, "fp").join(unplaced(first, "n"), F.col("fp") == F.col("n"), "left")
    placed = placed.select("key", "fp", F.coalesce("c", "fp").alias("c"), "lo")
    mixed = placed.groupBy("key").agg(F.max(F.when(F.col("fp") == F.col("lo"), F.col("c"))).alias("main"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    mixed = mixed.where(F.col("c0") != F.col("c1")).select("key", "main")
    rest = cut(unplaced(placed, "key").join(unplaced(mixed, "key"), "key").select("key", "fp", "c", "main"))
    left = unplaced(rest.where(F.col("c") != F.col("main")), "key").select("key", F.col("fp").alias("fp_a"), F.col("c").alias("a"))
    right = unplaced(rest, "key").select(F.col("key").alias("key_b"), F.col("fp").alias("fp_b"), F.col("c").alias("b"))
    close = (F.col("key") == F.col("key_b")) & (F.col("a") != F.col("b")) & (_differing(F.col("fp_a"), F.col("fp_b")) <= max_bits)
    across = left.join(right, close).select("a", "b")
    second = components(across).select(F.col("node").alias("n"), F.col("component").alias("c2"))
    alone = across.select(F.col("a").alias("fp")).union(across.select(F.col("b").alias("fp")))
    every = first.select(F.col("n").alias("fp"), "c").union(alone.select("fp", F.col("fp").alias("c")))
    every = every.groupBy("fp").agg(F.min("c").alias("c"))
    out = unplaced(every, "fp").join(second, F.col("c") == F.col("n"), "left")
    return cut(out.select("fp", F.coalesce("c2", "c").alias("component")))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, max_bits: int = 3) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of `docs`.

    component_id is the smallest id reachable over links between fingerprints at most `max_bits` apart; equal
    fingerprints link, the 0 of texts without words like any other. Null ids take part in links but never name a
    component; a component of null ids alone has component_id null. Texts are read once; what follows works on
    fingerprints, equal ones counted once.
    """
    own = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", width).select("doc_id", "fp"))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = linked_components(distinct.select("fp"), max_bits)
    named = unplaced(distinct, "fp").join(linked.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f"), "left")
    named = named.select("fp", "first", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    names = cut(unplaced(named, "c").join(unplaced(least, "c"), "c").select(F.col("fp").alias("f"), "component_id"))
    return unplaced(own, "fp").join(unplaced(names, "f"), F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")
