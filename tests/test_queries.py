"""Each query over the smallest tables against its DuckDB equivalent."""

import os

import duckdb
import pytest

from rivulet import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", core.QUERIES)
def test_query(spark, duck, name):
    frame = core.QUERIES[name](spark, DATA)
    got, columns = [tuple(r) for r in frame.collect()], frame.columns
    want = duck.execute(core.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(columns) == sorted(names)
    assert normal(got, columns) == normal(want.fetchall(), names)


def test_every_query_has_an_oracle():
    assert set(core.QUERIES) == set(core.ORACLES)
