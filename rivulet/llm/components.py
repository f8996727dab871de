"""Connected components of a graph given as edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import cut, release, unplaced


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (node, component) of all edges (u, v) that come."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            u, v = root(u), root(v)
            parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    for at in range(0, len(nodes), 1 << 16):
        some = nodes[at : at + (1 << 16)]
        yield pd.DataFrame({"node": np.array(some, np.int64), "component": np.array([root(x) for x in some], np.int64)})


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 500_000) -> DataFrame:
    """Rows (node, component) for each long that is an end of an edge; component is the smallest node reachable.

    At most `few` edges, counted first, are joined in one task (some MB). More are not gathered anywhere: labels start at
    the smallest neighbour; each round takes the smallest label next door and then the label of that label, so labels
    fall by jumps and long chains need about log n rounds. Each round is written to the checkpoint folder. The sides of
    each join that may hold a hot node are both exchanged, so adaptive execution splits it. Edges may repeat, point to
    themselves and stand in either direction; null ends are left out.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull()))
    if e.limit(few + 1).count() <= few:
        return cut(e.coalesce(1).mapInPandas(_together, "node long, component long"))
    both = cut(e.union(e.select("v", "u")).groupBy("u", "v").agg(F.lit(1).alias("__one")).select("u", "v"))
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"))
    while True:
        old = unplaced(labels, "node").select(F.col("node").alias("n"), F.col("label").alias("l"))
        near = unplaced(both, "u", "v").join(old, F.col("v") == F.col("n")).groupBy("u").agg(F.min("l").alias("m"))
        hooked = unplaced(labels, "node").join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jumped = hooked.join(old, F.col("label") == F.col("n")).select("node", "was", F.least("label", "l").alias("label"))
        new = cut(jumped)
        done = new.where(F.col("was") != F.col("label")).limit(1).count() == 0
        labels = new.select("node", "label")
        if done:
            release(labels.sparkSession)
            return labels.select("node", F.col("label").alias("component"))
