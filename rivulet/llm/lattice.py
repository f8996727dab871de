"""Near-duplicate vectors by hashing to points of the E8 lattice.

In each table a vector is projected at random to a few blocks of eight coordinates, each decoded to its nearest
lattice point; the points together name the vector's home cell. Each vector also probes the cells next to its
home that lie nearest. Vectors that meet in a cell are verified by cosine, in double precision.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.candidates import linked
from rivulet.llm.common import cut, unplaced


@functools.cache
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: from any lattice point they lead to its neighbours."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-1.0, 1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(v) for v in itertools.product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    f = np.rint(x)
    odd = np.nonzero(f.sum(axis=1) % 2)[0]
    if len(odd):
        off = x[odd] - f[odd]
        at = np.abs(off).argmax(axis=1)
        f[odd, at] += np.where(off[np.arange(len(odd)), at] >= 0, 1.0, -1.0)
    return f


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is the even-sum integer points and the same moved by halves."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def _cell(table: int, points: np.ndarray) -> np.ndarray:
    """A hash of lattice points (n, blocks * 8) as signed longs."""
    out = np.full(len(points), table + 1, np.uint64)
    for column in np.rint(points * 2).astype(np.int64).astype(np.uint64).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def cells(unit: np.ndarray, tables: int, blocks: int, probes: int, scale: float, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each table the home cells (n,) and the probed cells (n, probes) of unit vectors (n, d)."""
    n, d = unit.shape
    width = scale * math.sqrt(8 / d)
    for table in range(tables):
        rng = np.random.default_rng([seed, table, d])
        turned, _ = np.linalg.qr(rng.standard_normal((max(d, 8 * blocks), 8 * blocks)))
        x = (unit @ turned[:d]) / width + rng.uniform(0, 1, 8 * blocks)
        points = np.concatenate([nearest(x[:, 8 * b : 8 * b + 8]) for b in range(blocks)], axis=1)
        gains = np.concatenate([(x[:, 8 * b : 8 * b + 8] - points[:, 8 * b : 8 * b + 8]) @ roots().T for b in range(blocks)], axis=1)
        best = np.argsort(-gains, axis=1, kind="stable")[:, :probes]
        probed = np.empty((n, probes), np.int64)
        for k in range(probes):
            block, root = np.divmod(best[:, k], 240)
            moved = points.reshape(n, blocks, 8).copy()
            moved[np.arange(n), block] += roots()[root]
            probed[:, k] = _cell(table, moved.reshape(n, -1))
        yield _cell(table, points), probed


def unit_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (row, node, vec_id, dim, v), one for each row: v has length 1, in double precision.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing: their row, node and v
    are null. node is a hash of the components, so vectors of one direction are one node; row is a hash of id and
    components, so repeated rows are one row.
    """
    x = F.transform(F.col(embedding), lambda y: y.cast("double"))
    fine = F.forall(F.col("x"), lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    out = vectors.select(F.col(vec_id).alias("vec_id"), x.alias("x"))
    out = out.withColumn("x", F.when((F.size("x") > 0) & fine, F.col("x")))
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    out = out.withColumn("top", F.array_max(F.transform("x", F.abs)))
    out = out.withColumn("x", F.when(F.col("top") > 0, F.transform("x", lambda y: y / F.col("top"))))
    out = out.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, y: a + y * y)))
    out = out.withColumn("v", F.transform("x", lambda y: y / F.col("norm")))
    known = F.col("v").isNotNull()
    return out.select(F.when(known, F.xxhash64("vec_id", "v")).alias("row"), F.when(known, F.xxhash64("v")).alias("node"), "vec_id", F.size("v").alias("dim"), "v")


def _cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _keyed(units: DataFrame, tables: int, blocks: int, probes: int, scale: float, seed: int) -> DataFrame:
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, same in batch.groupby("dim"):
                node, unit = same["node"].to_numpy(), np.stack(same["v"].to_numpy())
                for at in range(0, len(node), 1024):
                    some = node[at : at + 1024]
                    for home, probed in cells(unit[at : at + 1024], tables, blocks, probes, scale, seed):
                        yield pd.DataFrame({"key": np.concatenate([home, probed.T.ravel()]), "node": np.tile(some, probes + 1)})

    return units.select("node", "dim", "v").mapInPandas(expand, "key long, node long")


def _counted(units: DataFrame, labels: DataFrame, least: float, block: int, fine: float) -> DataFrame:
    """Rows (node, n_links) for nodes of components: links to rows of other nodes, each pair of a component seen once.

    `units` has (node, v, times). A component of m nodes is dealt into m / `block` blocks by hash; each pair of blocks is
    a group of its own with two blocks of vectors at most, and only sums leave it.
    """
    members = unplaced(units, "node").join(unplaced(labels, "n"), F.col("node") == F.col("n")).select("node", "c", "v", "times")
    members = cut(members)
    # Each size stands under several sub-keys, over which the members of a large component are spread.
    # They are cut before, as Spark would take the table under its sub-keys to be as large as the one without.
    sizes = cut(members.groupBy("c").agg(F.count("*").alias("m")).select(F.col("c").alias("k"), F.ceil(F.col("m") / block).alias("nb")))
    sizes = sizes.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(15))))
    same = (F.col("c") == F.col("k")) & (F.pmod(F.hash("node"), F.lit(16)) == F.col("s"))
    dealt = members.join(sizes, same).select("node", "c", "v", "times", F.col("nb").cast("int").alias("nb"))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("node", F.lit(3)), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("node", "v", "times", "c", "b", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        v, b, node, times = np.stack(rows["v"].to_numpy()), rows["b"].to_numpy(), rows["node"].to_numpy(), rows["times"].to_numpy(np.int64)
        first = b == rows["b1"].iloc[0]
        own = rows["b1"].iloc[0] == rows["b2"].iloc[0]
        x, y = v[first], v if own else v[~first]
        near = x @ y.T
        # Close to the threshold the order of a sum might matter, so those few are summed exactly.
        for i, j in zip(*np.nonzero(np.abs(near - least) < fine), strict=True):
            near[i, j] = math.fsum(x[i] * y[j])
        hit = near >= least
        if own:
            np.fill_diagonal(hit, False)
            return pd.DataFrame({"node": node, "n": hit @ times})
        return pd.DataFrame({"node": np.concatenate([node[first], node[~first]]), "n": np.concatenate([hit @ times[~first], times[first] @ hit])})

    return dealt.groupBy("c", "b1", "b2").applyInPandas(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n_links"))


def lattice_of(n: int) -> tuple[int, int]:
    """(tables, blocks) for n vectors: the cells get finer as there are more, so that strangers seldom meet.

    Of random pairs at a cosine of 0.95 (64 and 256 dimensions), four blocks in 12 tables find 0.999, five in 20 tables
    0.999; a fifth block divides the strangers that meet by a hundred and more.
    """
    finer = max(0, math.ceil(math.log(max(n, 1) / 1e6, 100)))
    return 12 + 8 * finer, 4 + finer


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.95,
    tables: int | None = None, blocks: int | None = None, probes: int = 6, scale: float = 0.85, seed: int = 1, block: int = 128,
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of `vectors`; its other columns are not looked at.

    Vectors of equal dimension link at a cosine of `least` or more. component_id is the smallest vec_id reachable
    over links, the vector's own if it has none; kept says that it is its own. Vectors that may not link (see
    `unit_vectors`) have no links. Vectors of one direction are one node from the start, so a large group of them costs
    no comparison. An exactly repeated row is the same vector, linked with its twin by the shared id alone and counted
    once; rows that share an id with other components are vectors of their own. A null id never names a component. The
    lattice (`lattice_of`, if not given) finds the components; links are then counted over all pairs inside a component,
    so a pair counts even if no cell holds both.
    """
    tagged = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    rows = cut(unit_vectors(tagged))
    once = rows.where(F.col("row").isNotNull()).dropDuplicates(["row"])
    units = cut(once.groupBy("node").agg(F.count("*").alias("times"), F.min("vec_id").alias("least_id"), F.first("dim").alias("dim"), F.first("v").alias("v")))
    fitting = lattice_of(units.count())
    tables, blocks = tables or fitting[0], blocks or fitting[1]
    fine = 1e-12
    compared = units.select(F.col("node").alias("n"), F.col("v"))

    def verify(pairs: DataFrame) -> DataFrame:
        a = compared.select(F.col("n").alias("na"), F.col("v").alias("va"))
        b = compared.select(F.col("n").alias("nb"), F.col("v").alias("vb"))
        both = unplaced(pairs, "a").join(unplaced(a, "na"), F.col("a") == F.col("na")).select("a", "b", "va")
        both = unplaced(both, "b").join(unplaced(b, "nb"), F.col("b") == F.col("nb"))
        return both.where((F.size("va") == F.size("vb")) & (_cosine(F.col("va"), F.col("vb")) >= least)).select("a", "b")

    labels = cut(linked(_keyed(units, tables, blocks, probes, scale, seed), verify)).select(F.col("node").alias("n"), F.col("component").alias("c"))
    counts = _counted(units, labels, least, block, fine).select(F.col("node").alias("cn"), "n_links")
    named = unplaced(units.select("node", "times", "least_id"), "node").join(unplaced(labels, "n"), F.col("node") == F.col("n"), "left")
    named = named.select("node", "times", "least_id", F.coalesce("c", "node").alias("c"))
    first = named.groupBy("c").agg(F.min("least_id").alias("component_id")).select(F.col("c").alias("k"), "component_id")
    named = unplaced(named, "c").join(unplaced(first, "k"), F.col("c") == F.col("k"))
    known = unplaced(named.select("node", "times", "component_id"), "node").join(unplaced(counts, "cn"), F.col("node") == F.col("cn"), "left")
    known = cut(known.select(F.col("node").alias("kn"), "component_id", (F.col("times") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links")))
    out = unplaced(rows.select("vec_id", "node"), "node").join(unplaced(known, "kn"), F.col("node") == F.col("kn"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
