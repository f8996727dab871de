import pytest
from pyspark.sql import functions as F

from rivulet import functions as R


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, "order.eu.created", '{"a": {"b": "x"}, "n": 12.7, "s": "12.7", "z": null, "d.k": 1}', " pad "),
        (2, "order", "not json", "é"),
        (3, "", None, None),
        (4, "order..created", "[1]", ""),
    ]
    return spark.createDataFrame(data, "i int, subject string, payload string, t string").orderBy("i")


def values(rows, c):
    return [r[0] for r in rows.select(c).collect()]


def test_subject_part(rows):
    assert values(rows, R.subject_part("subject", 2)) == ["eu", None, None, ""]
    assert values(rows, R.subject_part("subject", 0)) == [None] * 4


@pytest.mark.parametrize("pattern, want", [
    ("order.*.created", [True, False, False, True]), ("order.>", [True, False, False, True]), (">", [True, True, True, True]), ("", [True] * 4), ("order", [False, True, False, False]), ("o.der.*", [False] * 4),
])
def test_subject_matches(rows, pattern, want):
    assert values(rows, R.subject_matches("subject", pattern)) == want


def test_json(rows):
    assert values(rows, R.json_text("payload", "a", "b")) == ["x", None, None, None]
    assert values(rows, R.json_text("payload", "z")) == [None] * 4
    assert values(rows, R.json_text("payload", "d.k")) == ["1", None, None, None]
    assert values(rows, R.json_get("payload", "a")) == ['{"b":"x"}', None, None, None]
    assert values(rows, R.json_text("payload", "n")) == ["12.7", None, None, None]


def test_casts_and_arithmetic(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(R.as_bigint(F.lit("12.7"))) is None or get(R.as_bigint(F.lit("12"))) == 12
    assert get(R.as_double(F.lit("x"))) is None and get(R.as_boolean(F.lit("yes"))) is True
    assert get(R.safe_div(F.lit(7), F.lit(2))) == 3.5 and get(R.safe_div(F.lit(7), F.lit(0))) is None
    assert get(R.safe_mod(F.lit(7), F.lit(0))) is None and get(R.safe_mod(F.lit(7), F.lit(4))) == 3
    assert [get(R.round_half_up(F.lit(x))) for x in (2.5, -2.5, 2.4)] == [3, -3, 2]


def test_strings(rows):
    assert values(rows, R.length("t")) == [5, 2, None, 0]
    assert values(rows, R.concat(F.lit("a"), "t", F.lit("b"))) == ["a pad b", "aéb", "ab", "ab"]
    assert values(rows, R.trim("t")) == ["pad", "é", None, ""]
    assert values(rows, R.substring("subject", 0, 5)) == ["order", "order", "", "order"]
    assert values(rows, R.substring("subject", 100)) == [""] * 4
    assert values(rows, R.like("subject", "ORDER%")) == [True, True, False, True]
