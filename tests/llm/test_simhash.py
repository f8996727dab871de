import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from rivulet.llm import simhash
from rivulet.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        parent[find(a)] = find(b)
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "ÀB c d e f", "a b c d e f g " * 30])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprints_in_slices(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(1000))
    monkeypatch.setattr(simhash, "_SHINGLES_AT_ONCE", 64)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@settings(deadline=None, max_examples=200)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_three_bits_apart_share_a_key(v, flips):
    u = v
    for b in flips:
        u ^= 1 << b
    _, a = simhash.candidate_keys(np.array([v], np.uint64))
    _, b = simhash.candidate_keys(np.array([u], np.uint64))
    assert set(a.tolist()) & set(b.tolist())


def test_golay_words_one_bit_apart_share_a_codeword(rng):
    v = np.array([rng.randrange(1 << 23) for _ in range(3000)])
    u = v ^ np.array([1 << rng.randrange(23) for _ in v])
    for x, y in zip(simhash.codeword_indices(v), simhash.codeword_indices(u), strict=True):
        assert set(x[x >= 0]) & set(y[y >= 0])


def test_linked_components_against_brute_force(spark, rng):
    base = [rng.getrandbits(64) for _ in range(30)]
    values = set(base) | {0, 1, 2**63}
    for b in base[:10]:  # chains: each step at most three bits on, ends far apart
        for _ in range(rng.randrange(1, 40)):
            for _ in range(rng.randrange(1, 4)):
                b ^= 1 << rng.randrange(64)
            values.add(b)
    v = np.array(sorted(values), np.uint64)
    pairs = [(i, j) for i in range(len(v)) for j in range(i) if int(v[i] ^ v[j]).bit_count() <= 3]
    want = groups(len(v), pairs)
    sizes = {g: want.count(g) for g in want}
    out = simhash.linked_components(spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long"))
    got = {r["fp"]: r["component"] for r in out.collect()}
    signed = v.view(np.int64).tolist()
    assert set(got) == {x for x, g in zip(signed, want, strict=True) if sizes[g] > 1}
    for i, j in ((i, j) for i in range(len(v)) for j in range(i)):
        if sizes[want[i]] > 1 and sizes[want[j]] > 1:
            assert (got[signed[i]] == got[signed[j]]) == (want[i] == want[j])


def test_keys_are_not_broadcast_by_the_size_of_their_fingerprints(spark, small_broadcasts):
    fps = spark.range(0, 30_000, 1, 4).selectExpr("xxhash64(id div 2) ^ (id % 2) AS fp").distinct()
    out = simhash.linked_components(fps)
    assert (out.count(), out.select("component").distinct().count()) == (30_000, 15_000)


def test_near_duplicates_of_odd_rows(odd, no_documents):
    out = simhash.near_duplicates(odd).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    fps = [plain_fingerprint(t) for _, t in texts]
    want = groups(len(texts), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {g: min((texts[k][0] for k in range(len(texts)) if want[k] == g and texts[k][0] is not None), default=None) for g in want}
    expect = sorted(((i, np.uint64(f).astype(np.int64).item(), least[g]) for (i, _), f, g in zip(texts, fps, want, strict=True)), key=repr)
    assert sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in out), key=repr) == expect
    assert simhash.near_duplicates(no_documents).count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_components_of_chains_and_stars(spark, few):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (300, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    assert {got[k] for k in range(61)} == {0} and {got[k] for k in range(100, 160)} == {100} and got[300] == got[200] == 200
    assert components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0
