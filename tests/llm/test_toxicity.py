from pyspark.sql import functions as F

from rivulet.llm import toxicity as T

PLAIN = "morning river stone garden window letter yellow market paper winter summer little people table".split()


def test_folding():
    assert T.fold("You ІDIOT!") == " you idiot " and T.fold("1d10t") == " idiot " and T.fold("ｓｔｕｐｉｄ") == " stupid " and T.fold("st­up​id") == " stupid "
    assert T.fold("in 2024, $5") == " in 2024 5 " and T.fold(None) == "" == T.fold(" !! ")
    assert T.fold("tr@$h") == " trash " and T.fold("idiot###") == " idiot " and T.fold("wow!!") == " wow "


def test_exceptions_and_boundaries():
    lexicon = T.Lexicon({" clown ": 5.0, " scum": 6.0}, (" scumble ",))
    weigh = lambda t: T.weigh(T.fold(t), lexicon.automaton())[0]
    assert weigh("a clown") == 5 and weigh("clownfish") == 0 and weigh("scummy scum") == 12 and weigh("scumble") == 0 and weigh("scumble scum") == 6
    assert T.weigh("", T.Lexicon({}).automaton()) == (0.0, 0)


def corpus(frame, rng, n=600):
    rows = []
    for k in range(n):
        words = [rng.choice(PLAIN) + rng.choice(["", "s", "er"]) for _ in range(rng.randrange(10, 120))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["wretch", "wr3tch", "VERMIN", "vеrmin", "oafish"]))
        rows.append((k, " ".join(words), int(toxic)))
    return frame(rows, "doc_id long, text string, toxic int")


def test_held_out_rows(frame, rng):
    docs = corpus(frame, rng)
    lexicon = T.train(docs, docs.where("doc_id % 3 <> 1"))
    assert {" wretch ", " vermin ", " oafish "} <= set(lexicon.weights)
    rows = T.scored(docs, lexicon).where("doc_id % 3 = 1").select("toxic", "score").collect()
    assert all((r["score"] >= 0.7) == bool(r["toxic"]) for r in rows)
    # Held-out labels never matter.
    flipped = docs.withColumn("toxic", F.when(F.col("doc_id") % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert T.train(flipped, flipped.where("doc_id % 3 <> 1")) == lexicon


def test_a_group_of_copies_does_not_make_entries(frame, rng):
    docs = corpus(frame, rng)
    odd = " ".join(f"strange{k}" for k in range(60)) + " wretch"
    copies = frame([(10_000 + k, odd + f" w{k}", 1) for k in range(200)], "doc_id long, text string, toxic int")
    lexicon = T.train(docs.union(copies), docs.union(copies))
    assert not any(w.startswith(" strange") for w in lexicon.weights)


def test_edges(odd, no_documents, frame):
    lexicon = T.Lexicon({" word ": 9.0})
    rows = T.scored(odd, lexicon).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert T.scored(no_documents, lexicon).count() == 0
    none = T.train(no_documents, frame([], "doc_id long, toxic int"))
    assert none == T.Lexicon({})
    one_sided = T.train(frame([(1, "a b", 1)], "doc_id long, text string, toxic int"), frame([(1, 1), (None, 1), (1, None)], "doc_id long, toxic int"))
    assert one_sided.weights == {}


def test_matcher_against_brute_force(rng):
    words = ["ab", "abc", "abcd", "b", "bc", "xab", "ab1", "c"]
    for _ in range(300):
        weights = {" " + rng.choice(words) + rng.choice(["", " "]): rng.uniform(-1, 5) for _ in range(4)}
        exceptions = tuple({f" {rng.choice(words)} {rng.choice(words)} " if rng.random() < 0.5 else f" {rng.choice(words)} " for _ in range(2)})
        folded = T.fold(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))))
        spared = {i for p in exceptions for at in range(len(folded)) if folded.startswith(p, at) for i in range(at, at + len(p) - 1)}
        want = 0.0
        for at in range(len(folded)):
            here = [w for e, w in weights.items() if folded.startswith(e, at)]
            want += max(here) if here and at not in spared else 0.0
        got, n = T.weigh(folded, T.Lexicon(weights, exceptions).automaton())
        assert abs(got - want) < 1e-9 and n == len(folded.split())


def test_exceptions_are_phrases_too(frame, rng):
    docs = corpus(frame, rng)
    more = frame([(20_000 + k, f"the vermin control of town {k} wrote " + " ".join(rng.choice(PLAIN) for _ in range(40)), 0) for k in range(8)], "doc_id long, text string, toxic int")
    every = docs.union(more)
    lexicon = T.train(every, every)
    assert " vermin control " in lexicon.exceptions and " vermin " in lexicon.weights
    weigh = lambda t: T.weigh(T.fold(t), lexicon.automaton())[0]
    assert weigh("the vermin control came") == 0 and weigh("you vermin") > 3


def test_training_does_not_depend_on_order(frame, rng):
    docs = corpus(frame, rng)
    assert T.train(docs.repartition(7), docs) == T.train(docs.coalesce(1), docs.orderBy("text"))


def test_columns_with_clashing_names(frame):
    out = T.scored(frame([(1, "word", "mine", 2)], "doc_id long, text string, score string, weight int"), T.Lexicon({" word ": 9.0}))
    assert out.columns == ["doc_id", "text", "weight", "n_folded_words", "score"] and out.first()["weight"] == 9.0
