import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rivulet.llm import mixing, packing


def filled(sizes, weights=(1, 2, 3), most=3.0):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    total = sum(sizes.values())
    target = {n: total * w[n] / sum(w.values()) for n in names}
    for _ in range(1000):
        over = sum(max(0, target[n] - most * sizes[n]) for n in names)
        target = {n: min(target[n], most * sizes[n]) for n in names}
        free = [n for n in names if target[n] < most * sizes[n] - 1e-9]
        if over < 1e-9 or not free:
            break
        for n in free:
            target[n] += over * w[n] / sum(w[m] for m in free)
    return target


def corpus(frame, rng, counts):
    rows, k = [], 0
    for source, n in counts.items():
        for _ in range(n):
            rows.append((k, " ".join(["w"] * rng.randrange(1, 60)), source))
            k += 1
    return frame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("counts", [{"a": 300, "b": 50, "c": 20, None: 10}, {"a": 5, "b": 500}, {"only": 40}, {"é": 30, "Z": 30, "z": 30, "": 30}])
def test_targets_and_totals(frame, rng, counts):
    docs = corpus(frame, rng, counts)
    rows = mixing.mix(docs, leaf=32).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    want = filled(sizes)
    taken, largest = Counter(), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
        rate = r["target"] / r["source_size"]
        assert math.floor(rate + 1e-9) <= r["copies"] <= math.ceil(rate - 1e-9)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_reruns_and_other_partitionings_agree(frame, rng):
    docs = corpus(frame, rng, {"a": 200, "b": 60})
    one = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, leaf=16).collect()}
    two = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.orderBy(F.desc("doc_id")).repartition(7), leaf=16).collect()}
    assert one == two


def test_expectations_hold():
    """Over many draws each document is taken as often as its share says, and each draw takes the sum."""
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"doc_id": range(40), "rh": rng.integers(0, 2**60, 40), "size": rng.integers(0, 9, 40), "copies": 0, "frac": rng.uniform(0, 1, 40), "draw": 0.0})
    go, taken, runs = mixing._rounded(True), np.zeros(40), 2000
    for _ in range(runs):
        out = go(rows.assign(draw=rng.uniform(0, 1, 40))).sort_values("doc_id")
        assert set(out["copies"]) <= {0, 1} and not out["frac"].any()
        assert abs((out["copies"] * out["size"]).sum() - (rows["frac"] * rows["size"]).sum()) <= 8
        taken += out["copies"].to_numpy()
    # Four standard deviations of a mean of so many draws.
    assert np.abs(taken / runs - rows["frac"]).max() < 4 * 0.5 / np.sqrt(runs)


def test_many_sources(frame):
    """A source for each document: targets against a plain computation."""
    docs = frame([(k, "w " * (k % 7 * k % 50), f"s{k:04}") for k in range(700)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["target"] for r in mixing.mix(docs).collect()}
    size, weight, level = [k % 7 * k % 50 for k in range(700)], [k % 3 + 1 for k in range(700)], 0.0
    for _ in range(100):
        full = [3 * s <= w * level for s, w in zip(size, weight, strict=True)]
        level = (sum(size) - 3 * sum(s for s, f in zip(size, full, strict=True) if f)) / sum(w for w, f in zip(weight, full, strict=True) if not f)
    assert all(abs(got[k] - min(3 * size[k], weight[k] * level)) < 1e-6 for k in range(700)) and abs(sum(got.values()) - sum(size)) < 1e-6


def test_mixed_documents_repeat_rows(odd, no_documents, frame):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    copies = Counter((r["doc_id"], r["rh"]) for r in mixing.mix(odd).collect() for _ in range(r["copies"]))
    assert sum(copies.values()) == out.count()
    assert mixing.mix(no_documents).count() == 0 and mixing.mixed_documents(no_documents).count() == 0
    empty = mixing.mix(frame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()
    assert all(r["taken"] == 0 and r["target"] == 0 for r in empty)


def padding(lengths, counts, bounds):
    return sum(n * min(b for b in bounds if b >= x) for x, n in zip(lengths, counts, strict=True))


def test_boundaries_are_optimal(rng):
    for _ in range(150):
        lengths = sorted(rng.sample(range(1, 40), rng.randrange(1, 8)))
        counts, k = [rng.randrange(1, 30) for _ in lengths], rng.randrange(1, 6)
        got = packing.optimal_boundaries(lengths, counts, k)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for n in range(k) for c in itertools.combinations(lengths[:-1], n))
        assert len(got) <= k and padding(lengths, counts, got) == best
    assert packing.optimal_boundaries([], [], 3) == []


def check_batches(rows, max_len, budget):
    pieces, batches = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 <= r["n_tokens"] <= min(max_len, r["bucket"]) and r["start"] == r["piece"] * max_len
        batches[r["bucket"], r["chunk"], r["batch"]].append(r["slot"])
        pieces[r["doc_id"]].append(r["n_tokens"])
    for (bucket, _, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and (len(slots) * bucket <= budget or len(slots) == 1)
    return pieces


def test_packing_keeps_every_token(frame, rng):
    docs = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 17, 40, 41, 300]))) for k in range(300)]
    rows = packing.pack(frame(docs, "doc_id long, text string"), max_len=64, budget=256, buckets=4, chunk=16).collect()
    pieces = check_batches(rows, 64, 256)
    assert {k: sum(v) for k, v in pieces.items()} == {k: len(t.split()) for k, t in docs}
    assert len({r["bucket"] for r in rows}) <= 4


def test_packing_edges(odd, no_documents):
    rows = packing.pack(odd, max_len=1000, budget=100).collect()
    check_batches(rows, 1000, 100)
    assert sum(r["n_tokens"] for r in rows) == sum(len((r["text"] or "").encode().split()) for r in odd.collect())
    assert len([r for r in rows if r["n_tokens"] == 0]) == 4  # null, empty and blank texts
    assert packing.pack(no_documents).count() == 0
