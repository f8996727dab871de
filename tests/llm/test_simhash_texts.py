import math
import os
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rivulet.llm import simhash_texts as X


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def groups(n, linked):
    """Each member's smallest fellow."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def similar(texts, least=0.8):
    """All pairs of similar texts: by all shingles that two of them share."""
    s = [shingles(t) for t in texts]
    having = defaultdict(list)
    for k, own in enumerate(s):
        # A set that agrees with this one by `least` shares one of so many of its members, in any fixed order.
        for x in sorted(own)[: len(own) - math.ceil(least * len(own) - 1e-9) + 1]:
            having[x].append(k)
    pairs = {(a, b) for ks in having.values() for a in ks for b in ks if a > b}
    return [(a, b) for a, b in pairs if len(s[a] & s[b]) >= least * len(s[a] | s[b])]


def edited(rng, words, edits):
    copy = list(words)
    for at in rng.sample(range(0, len(copy), 5), edits):
        copy[at] = f"new{rng.randrange(10**9)}"
    return " ".join(copy)


def kept(spark, texts, **options):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, node string")
    out = X.drop_near_duplicates(docs, **options)
    assert out.columns == docs.columns
    return {r["doc_id"] for r in out.collect()}


def test_text_groups_against_brute_force(spark, rng):
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(150)]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            copy = list(words)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += ["", None, "  ", texts[0].upper(), "one two", "one  two"]
    assert kept(spark, texts) == set(groups(len(texts), similar(texts)))


def test_edited_copies_that_only_their_original_links(spark, rng):
    words = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = [edited(rng, words, 6) for _ in range(500)] + [" ".join(words)]
    s = [shingles(t) for t in texts]
    assert all(len(x & s[-1]) >= 0.8 * len(x | s[-1]) for x in s)
    assert len(similar(texts)) < 700
    assert kept(spark, texts) == {0}


def test_edited_copies_at_the_edge_in_small_blocks(spark, rng):
    words = [f"w{rng.randrange(3000)}" for _ in range(200)]
    texts = [edited(rng, words, rng.randrange(1, 6)) for _ in range(120)]
    want = groups(len(texts), similar(texts))
    assert len(set(want)) > 1
    assert kept(spark, texts, block=7, few=0) == set(want)


def test_twenty_pairs_that_share_one_key(spark, rng, monkeypatch):
    class OneKey(X._Search):
        def keyed(self, nodes):
            return nodes.select(F.lit(5).cast("long").alias("key"), "tag", "g")

    monkeypatch.setattr(X, "_Search", OneKey)
    texts = []
    for k in range(20):
        words = [f"w{k}x{rng.randrange(500)}" for _ in range(120)]
        texts += [" ".join(words), edited(rng, words, 1)]
    assert kept(spark, texts) == set(range(0, 40, 2))


@settings(deadline=None, max_examples=100)
@given(st.integers(1, 3000), st.integers(0, 400), st.integers(0, 400), st.integers(0, 2**32))
def test_parities_never_rule_out_what_is_similar(common, own, other, seed):
    values = np.random.default_rng(seed).integers(0, 2**63, common + own + other, dtype=np.uint64)
    x, y = np.unique(values[: common + own]), np.unique(np.concatenate([values[:common], values[common + own :]]))
    share = X.near_in_block([X.parities(x)], [X.parities(y)], np.array([len(x)]), np.array([len(y)]), 0.8)[0, 0]
    both = len(np.intersect1d(x, y))
    if both >= 0.8 * (len(x) + len(y) - both):
        assert share > 0
    if len(x) > 100 and both < 0.6 * (len(x) + len(y) - both):
        assert share == 0


def test_shingles_and_fingerprints(rng):
    known = X._Hashes()
    for text in (None, "", "a", "a b", "a b c d e", "A b C d e f a b c d e", " ".join(f"w{rng.randrange(50)}" for _ in range(2000))):
        w = X.word_hashes(text, known)
        assert len(X.shingles(w, 5)) == len(shingles(text))
        assert np.array_equal(X.word_fingerprints(w, 3), X.word_fingerprints(np.sort(w), 3))
    assert not X.word_fingerprints(X.word_hashes("", known), 2).any()


def test_text_groups_edges(odd, no_documents, spark):
    out = X.drop_near_duplicates(odd)
    assert out.columns == odd.columns
    assert [r["doc_id"] for r in out.where("text is null or trim(text) = ''").collect()] == [0]
    assert out.where("text = 'same same'").count() == 1 and out.where("doc_id is null").count() == 1
    assert X.drop_near_duplicates(no_documents).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_documents(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path).select("doc_id", "text").orderBy("doc_id")
    rows = docs.collect()
    want = groups(len(rows), similar([r["text"] for r in rows]))
    got = {r["doc_id"] for r in X.drop_near_duplicates(docs).collect()}
    gone = len(rows) - len(set(want))
    assert gone > 0 and got >= {rows[k]["doc_id"] for k in set(want)}
    assert len(rows) - len(got) >= 0.99 * gone
