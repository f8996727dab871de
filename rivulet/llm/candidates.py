"""Components of rows that share keys and pass a verification, without listing the pairs of a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import cut, unplaced
from rivulet.llm.components import components


def _named(found: DataFrame) -> DataFrame:
    return found.select(F.col("node").alias("n"), F.col("component").alias("c"))


def _placed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """`rows` with the component of each node; a node without one is its own."""
    out = unplaced(rows, "node").join(unplaced(labels, "n"), F.col("node") == F.col("n"), "left")
    return out.select(*rows.columns, F.coalesce("c", "node").alias("c"))


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Each unordered pair once."""
    return rows.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.lit(1).alias("__one")).select("a", "b")


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows of keys that two nodes or more have, with the key's smallest and largest node."""
    ends = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where(F.col("lo") != F.col("hi"))
    return cut(unplaced(keyed, "key").join(unplaced(ends, "key"), "key").select("key", "node", "lo", "hi"))


def linked(keyed: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (node, component) for the nodes (longs) of `keyed` (key, node: longs) that link with another one.

    `keyed` should come from rows that are cut: Spark takes expanded rows to be as large as what an exchange below them
    brought, and would broadcast them. `verify` gets pairs (a, b) and returns those that link. First each node of a key is verified against the smallest
    and the largest node of the key, which joins nearly all of a group of copies at a cost in proportion to the rows.
    Then the nodes that are still in another component than their key's smallest are verified against all nodes of
    the key outside their own component, so no link between two rows of a key is lost.
    """
    shared = _shared(keyed)
    stars = shared.select("node", F.explode(F.array("lo", "hi")).alias("other"))
    links = cut(verify(_pairs(stars, "node", "other")).select("a", "b"))
    labels = _named(components(links))
    placed = _placed(shared, labels)
    mixed = placed.groupBy("key").agg(F.max(F.when(F.col("node") == F.col("lo"), F.col("c"))).alias("main"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    mixed = mixed.where(F.col("c0") != F.col("c1")).select("key", "main")
    rest = cut(unplaced(placed, "key").join(unplaced(mixed, "key"), "key").select("key", "node", "c", "main"))
    left = unplaced(rest.where(F.col("c") != F.col("main")), "key").select("key", F.col("node").alias("x"), F.col("c").alias("cx"))
    right = unplaced(rest, "key").select(F.col("key").alias("k"), F.col("node").alias("y"), F.col("c").alias("cy"))
    across = left.join(right, (F.col("key") == F.col("k")) & (F.col("cx") != F.col("cy")))
    more = cut(verify(_pairs(across, "x", "y")).select("a", "b"))
    return components(links.union(more)) if more.limit(1).count() else labels.select(F.col("n").alias("node"), F.col("c").alias("component"))
