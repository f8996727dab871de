"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies. Whole copies are certain; the fractional parts
are rounded in pairs: word mass moves at random from one document to the other until one of the two is whole, so
expectations hold for each document and the words of a pair do not change. A leaf of documents leaves at most one
fraction; the fractions of the leaves meet in the same way in a tree of groups of bounded size.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import cut, n_words

_NEAR = 1e-9


def _key(source: Column) -> Column:
    """A source's name that null shares with no string and that sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def _ranked(rows: DataFrame, by: str, name: str) -> DataFrame:
    """`rows` with their places in the order of `by` (unique), from 0 on: sorted in ranges, whose counts alone meet."""
    dealt = cut(rows.repartitionByRange(by).sortWithinPartitions(by).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = {r["__p"]: r["count"] for r in dealt.groupBy("__p").count().collect()}  # one number for each partition
    starts = [0, *accumulate(counts.get(k, 0) for k in range(max(counts, default=0)))]
    start = F.get(F.lit(starts).cast("array<long>"), F.col("__p"))
    return dealt.withColumn(name, start + F.col("__i")).drop("__p", "__i")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeat: float = 3.0) -> DataFrame:
    """Rows (key, source_size, n_docs, target) for `sized` (key, size): one row for each source.

    Sources ordered by key take the weights in turn. Targets share the sum of all sizes by weight; none exceeds
    `max_repeat` times its source's size, and what is over is shared among the others by weight until none is above.
    The level at which weights are paid rises in rounds, each a sum over the sources: those whose limit it passes are
    full and leave the rest to the others. Sources may be many: no task holds them all.
    """
    sources = sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    out = cut(_ranked(sources, "key", "__rank").withColumn("weight", weight).drop("__rank"))
    limit = F.col("source_size") * F.lit(float(max_repeat))
    total, level, full = None, 0.0, -1
    while True:
        open_ = limit > F.col("weight") * F.lit(level)
        r = out.agg(F.sum("source_size"), F.sum(F.when(~open_, F.col("source_size"))), F.sum(F.when(open_, F.col("weight"))), F.sum((~open_).cast("long"))).first()
        total = r[0] or 0
        if not r[2] or r[3] == full:
            break
        # The sum of the sizes is shared out, so what is left is never less than at a lower level.
        level, full = max(level, (total - float(max_repeat) * (r[1] or 0)) / r[2]), r[3]
    paid = F.col("weight") * F.lit(level)
    return out.withColumn("target", F.least(limit, paid)).select("key", "source_size", "n_docs", "target")


def _rounded(final: bool):
    """Rounds the fractions of one group until at most one is left, and that one too if `final`."""

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "rh"], ascending=[False, True], kind="stable").reset_index(drop=True)
        size, draw = rows["size"].to_numpy(float), rows["draw"].to_numpy(float)
        mass = rows["frac"].to_numpy(float) * size
        i = -1
        for j in np.nonzero((rows["frac"].to_numpy() > _NEAR) & (size > 0))[0].tolist():
            if i < 0:
                i = j
                continue
            up, down = min(size[i] - mass[i], mass[j]), min(mass[i], size[j] - mass[j])
            move = up if draw[j] * (up + down) < down else -down
            mass[i] += move
            mass[j] -= move
            open_i, open_j = (_NEAR * size[k] < mass[k] < (1 - _NEAR) * size[k] for k in (i, j))
            i = i if open_i else j if open_j else -1
        frac = np.where(size > 0, mass / np.where(size > 0, size, 1), (draw < rows["frac"].to_numpy()).astype(float))
        if final and i >= 0:
            # The low bits of a draw; its size may have told where mass went.
            frac[i] = float(draw[i] * (1 << 26) % 1 < frac[i])
        rows["copies"] += (frac > 1 - _NEAR).astype(np.int64)
        rows["frac"] = np.where((frac > 1 - _NEAR) | (frac < _NEAR), 0.0, frac)
        return rows

    return go


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
    weights: tuple[float, ...] = (1, 2, 3), max_repeat: float = 3.0, leaf: int = 1024, seed: int = 7, salts: int = 32,
) -> DataFrame:
    """Rows (doc_id, source, rh, size, source_size, target, copies, taken), one for each row of `docs`.

    size is the number of words (0 for null), rh the row's hash over id and text, copies the number of times that
    the mix takes the row, at most `max_repeat` rounded up, taken their words. The words taken of a source differ
    from its target by less than one document. Null sources are one source, last in order; rows without words get
    copies by chance alone. Draws come from row hashes, so reruns and other partitionings give the same rows;
    exactly repeated rows may swap their copies. An empty table gives an empty result.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(doc_id, text).alias("rh"))
    sized = cut(named.withColumn("key", _key(F.col("source"))))
    targets = cut(source_targets(sized, weights, max_repeat))
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    spread = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = sized.withColumn("salt", F.pmod(F.hash("rh"), F.lit(salts))).join(spread, ["key", "salt"]).drop("salt")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_repeat)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("copies", F.floor(rate + _NEAR).cast("long")).withColumn("frac", F.greatest(F.lit(0.0), rate - F.col("copies")))
    rows = rows.withColumn("leaf", F.pmod(F.xxhash64("rh", F.lit(seed)), F.ceil(F.col("n_docs") / leaf)))
    rows = rows.select("doc_id", "source", "key", "rh", "size", "source_size", "target", "copies", "frac", "leaf")
    parts, level, groups = [], 0, -(-most // leaf)
    while True:
        drawn = rows.withColumn("draw", (F.shiftrightunsigned(F.xxhash64("rh", F.lit(seed), F.lit(level)), 11)) / F.lit(float(1 << 53)))
        final = groups <= 1
        done = drawn.groupBy("key", "leaf").applyInPandas(_rounded(final), drawn.schema)
        if final:
            parts.append(done)
            break
        done = cut(done)
        parts.append(done.where(F.col("frac") == 0))
        rows = done.where(F.col("frac") > 0).drop("draw").withColumn("leaf", F.floor(F.col("leaf") / leaf))
        level, groups = level + 1, -(-groups // leaf)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "source", "rh", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """`docs` with each row repeated as often as `mix` takes it; rows that it does not take are gone."""
    taken = mix(docs, text, source, doc_id, **options).where(F.col("copies") > 0).groupBy(F.col("doc_id").alias("__id"), F.col("rh").alias("__mh")).agg(
        F.sort_array(F.collect_list("copies")).alias("__c")
    )
    # Exactly repeated rows are numbered, so that each takes one of their counts.
    base = docs.withColumn("__rh", F.xxhash64(doc_id, text))
    counted = base.withColumn("__k", F.row_number().over(Window.partitionBy(F.col(doc_id), "__rh").orderBy(F.lit(1))))
    both = counted.join(taken, counted[doc_id].eqNullSafe(taken["__id"]) & (counted["__rh"] == taken["__mh"]))
    times = F.coalesce(F.get("__c", F.col("__k") - 1), F.lit(0))
    out = both.where(times > 0).withColumn("__n", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    return out.select(*docs.columns)
