"""Packing documents into token-budget batches inside optimal length buckets."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import cut, n_words


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most `buckets` upper bounds, taken from the distinct `lengths`, with the least padding in all.

    Dynamic programming: cells[j] is the least number of cells for the lengths up to the j-th in k buckets, the last
    of which ends there; the last bucket starts after some i. The last bound is the largest length.
    """
    order = np.argsort(lengths)
    b, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    if not len(b):
        return []
    upto = np.concatenate(([0], np.cumsum(c)))
    cells, cuts = b * upto[1:], []
    for _ in range(1, min(buckets, len(b))):
        grown, came = cells.copy(), np.full(len(b), -1)
        for j in range(1, len(b)):
            costs = cells[:j] + b[j] * (upto[j + 1] - upto[1 : j + 1])
            i = int(costs.argmin())
            if costs[i] < grown[j]:
                grown[j], came[j] = costs[i], i
        cuts.append(came)
        cells = grown
    out, j = [int(b[-1])], len(b) - 1
    for came in reversed(cuts):
        if came[j] >= 0:
            j = came[j]
            out.append(int(b[j]))
    return sorted(out)


def sequences(docs: DataFrame, length: Column, max_len: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, rh, piece, start, n_tokens): each document cut into pieces of `max_len` tokens and a rest.

    A document without tokens is one piece of none.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("rh"), length.cast("long").alias("n"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / max_len) - 1).cast("int")
    out = base.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece").cast("long") * max_len
    return out.select("doc_id", "rh", "piece", start.alias("start"), F.least(F.lit(max_len).cast("long"), F.col("n") - start).alias("n_tokens"))


def pack(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: Column | None = None,
    max_len: int = 4096, budget: int = 32768, buckets: int = 12, chunk: int = 1024,
) -> DataFrame:
    """Rows (doc_id, piece, start, n_tokens, bucket, chunk, batch, slot): the batch that takes each piece.

    `length` is a column with a document's tokens; words if none is given. The histogram over all pieces has at most
    `max_len` + 1 rows, whatever the corpus; from it come the bounds of at most `buckets` buckets. A piece goes to
    the lowest bucket that holds it and is padded to the bucket's bound; a batch takes pieces while their padded
    tokens stay within `budget` (one piece at least). Buckets are dealt into chunks of about `chunk` pieces, four
    batches at least, by row hash, and each chunk fills batches of its own, so no bucket gathers in a task.
    A batch is named by (bucket, chunk, batch). Nothing is dropped: null and empty texts are pieces of 0 tokens,
    equal rows are pieces of their own, ties in order are between equal rows only.
    """
    length = n_words(F.col(text)) if length is None else F.coalesce(length, F.lit(0))
    pieces = cut(sequences(docs, length, max_len, doc_id, text))
    found = pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()  # at most max_len + 1 rows
    bounds = optimal_boundaries([max(1, r["n_tokens"]) for r in found], [r["n"] for r in found], buckets)
    count = dict.fromkeys(bounds, 0)
    for r in found:
        count[min(b for b in bounds if b >= r["n_tokens"])] += r["n"]
    holds = {b: max(1, budget // b) for b in bounds}
    chunks = {b: max(1, round(count[b] / max(chunk, 4 * holds[b]))) for b in bounds}

    def by_bucket(values: dict[int, int]) -> Column:
        return reduce(lambda out, b: F.when(F.col("bucket") == b, values[b]).otherwise(out), bounds, F.lit(1)).cast("long")

    bucket = reduce(lambda out, b: F.when(F.col("n_tokens") <= b, b).otherwise(out), reversed(bounds), F.lit(max_len)).cast("long")
    out = pieces.withColumn("bucket", bucket).withColumn("chunk", F.pmod(F.xxhash64("rh", "piece"), by_bucket(chunks)))
    order = Window.partitionBy("bucket", "chunk").orderBy("rh", "doc_id", "piece")
    out = out.withColumn("rn", F.row_number().over(order) - 1).withColumn("holds", by_bucket(holds))
    return out.select(
        "doc_id", "piece", "start", "n_tokens", "bucket", "chunk",
        F.floor(F.col("rn") / F.col("holds")).alias("batch"), (F.col("rn") % F.col("holds")).cast("int").alias("slot"),
    )
