import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n, vocabulary=WORDS):
    return " ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


#: Texts that every operator on documents must take: null, empty, blank, one word, long, repeated rows, odd characters.
ODD_TEXTS = [None, "", " \t\n", "word", "\n\n\n", "a b é \U0001f600", "x" * 50_000, "w " * 30_000, "same same", "same same", "\x00\x1f", "{}[]$%"]


@pytest.fixture
def odd(frame):
    rows = [(k if k != 8 else 9, t, None if k % 3 else "en", None if k % 2 else "src", 1.0, 2) for k, t in enumerate(ODD_TEXTS)] + [(None, "null id", "en", "src", 1.0, 2)]
    # Columns beyond the documents' own clash with names that operators use inside.
    return frame(rows, "doc_id long, text string, lang string, source string, size double, key int")


@pytest.fixture
def no_documents(frame):
    return frame([], "doc_id long, text string, lang string, source string")


@pytest.fixture
def small_broadcasts(spark):
    """Tables that Spark takes to be small are broadcast, and one that turns out to be much larger is an error. A page of a hash table alone is 32 MB here."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "1m", "spark.sql.maxBroadcastTableSize": "40m"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)
