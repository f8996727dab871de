import itertools
import math

import numpy as np
import pytest

from rivulet.llm import lattice
from rivulet.llm.common import cut


def test_roots_and_nearest_points(rng):
    r = lattice.roots()
    assert r.shape == (240, 8) and np.allclose((r**2).sum(1), 2) and len(np.unique(r, axis=0)) == 240
    x = np.array([[rng.gauss(0, 3) for _ in range(8)] for _ in range(500)])
    p = lattice.nearest(x)
    whole = np.isclose(p, np.rint(p)).all(1)
    assert ((p[whole].sum(1) % 2) == 0).all() and (((p[~whole] - 0.5).sum(1) % 2) == 0).all()
    # No neighbour is nearer; covering radius of E8 is 1.
    assert (((x - p) @ r.T).max(1) <= 1 + 1e-9).all() and (((x - p) ** 2).sum(1) <= 1 + 1e-9).all()


def near(rng, v, cosine):
    z = rng.standard_normal(len(v))
    z -= (z @ v) * v
    return cosine * v + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def unit(rng, d=64):
    v = rng.standard_normal(d)
    return v / np.linalg.norm(v)


@pytest.mark.parametrize("n", [10, 10**9])
def test_recall_at_the_threshold(n):
    rng = np.random.default_rng(5)
    a = np.stack([unit(rng) for _ in range(1500)])
    b = np.stack([near(rng, v, 0.9501) for v in a])
    tables, blocks = lattice.lattice_of(n)
    assert blocks == {10: 4, 10**9: 6}[n]
    args = dict(tables=tables, blocks=blocks, probes=6, scale=0.85, seed=1)
    hit = np.zeros(len(a), bool)
    for (h, p), (g, q) in zip(lattice.cells(a, **args), lattice.cells(b, **args), strict=True):
        x, y = np.column_stack([h, p]), np.column_stack([g, q])
        hit |= (x[:, :, None] == y[:, None, :]).any((1, 2))
    assert hit.mean() >= 0.99


def plain(rows, least=0.95):
    good = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v, float)
            u /= np.abs(u).max()
            good[k] = u / np.linalg.norm(u)
    links = {k: set() for k in range(len(rows))}
    for i, j in itertools.combinations(good, 2):
        if len(good[i]) == len(good[j]) and good[i] @ good[j] >= least:
            links[i].add(j)
            links[j].add(i)
    out = []
    for k, (vid, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in links[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        c = min(rows[m][0] for m in seen)
        out.append((vid, len(links[k]), c, c == vid))
    return sorted(out)


@pytest.mark.parametrize("block", [8, 512])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(60):
        v = unit(rng)
        rows.append(v)
        rows += [near(rng, v, c) for c in rng.uniform(0.93, 0.999, rng.integers(0, 4))]
    hub = unit(rng)
    rows += [near(rng, hub, 0.985) for _ in range(60)]  # a large group, chained where pairs differ more
    ids = rng.permutation(len(rows))
    data = [(int(i), [float(x) for x in v]) for i, v in zip(ids, rows, strict=True)]
    got = lattice.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>"), block=block)
    assert sorted(map(tuple, got.collect())) == plain(data)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e300, 1e299]), (11, [1e-300, 1e-301]), (12, [-1.0, 0.0])]
    rows = spark.createDataFrame([(i, v, "x", 1) for i, v in data], "vec_id long, embedding array<double>, label string, node int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_duplicates(rows).collect()}
    assert sorted((k, *v) for k, v in got.items()) == plain(data)
    assert got[7] == (3, 7, True) and got[8][1] == 7 and got[9][0] == 0 and got[3] == (0, 3, True)
    assert lattice.near_duplicates(rows.limit(0)).count() == 0
    twice = lattice.near_duplicates(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")).collect()
    assert [tuple(r) for r in twice] == [(1, 0, 1, True)] * 3


def test_vectors_of_one_direction(spark):
    rng = np.random.default_rng(5)
    v = unit(rng)
    data = [(k, [float(x) for x in v * 2 ** (k % 3)]) for k in range(300)] + [(1000 + k, [float(x) for x in near(rng, v, 0.99)]) for k in range(3)] + [(5, [float(x) for x in v])]
    got = lattice.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>"), block=8)
    rows = {r["vec_id"]: r for r in got.collect()}
    assert {r["component_id"] for r in rows.values()} == {0}
    # Rows of one id that are longer are vectors of the same direction, and so are the same row.
    assert {rows[k]["n_links"] for k in range(300)} == {302}


def test_sizes_are_cut_before_they_stand_under_sub_keys(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(lattice, "cut", lambda df: sent.append(df) or cut(df))
    units = spark.createDataFrame([(k, [1.0, 0.0], 1) for k in range(8)], "node long, v array<double>, times long")
    labels = spark.createDataFrame([(k, k // 2) for k in range(8)], "n long, c long")
    out = lattice._counted(units, labels, 0.95, 128, 1e-12)
    assert {(r["node"], r["n_links"]) for r in out.collect()} == {(k, 1) for k in range(8)}
    assert any(df.columns == ["k", "nb"] for df in sent)
