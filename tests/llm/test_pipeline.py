import os

import corpus_pipeline as P
import pytest

from rivulet.llm import oracles, queries

DATA = "/root/testdata/sf0.001"


def documents(spark, rng):
    words = [f"term{k}" for k in range(4000)]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(15)) + "." for _ in range(n))
    rows = [(k, text(6), "en", f"s{k % 3}") for k in range(60)]
    rows += [(100 + k, rows[0][1], "en", "s0") for k in range(3)]  # exact copies
    rows += [(200, rows[1][1].replace("term1", "term9", 1), "en", "s1")]  # a near copy
    rows += [(300 + k, f"Shared line of the site\n{text(5)}", "de", "s2") for k in range(12)]
    rows += [(400, "x | y | z | w\n" * 40, "en", "s0"), (401, None, None, None), (402, "", "en", "s0"), (403, "short", "en", "s0")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_each_stage_works_on_what_the_last_one_kept(spark, rng, tmp_path):
    docs = documents(spark, rng)
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == P.COLUMNS
    ids = {name: {r["doc_id"] for r in d.collect()} for name, d in kept.items()}
    assert {400, 401, 402, 403}.isdisjoint(ids["quality rules"]) and set(range(60)) <= ids["quality rules"]
    assert all("Shared line" not in r["text"] for r in kept["line dedup"].collect()) and ids["line dedup"] == ids["quality rules"]
    near = ids["SimHash near-dedup"]
    assert {100, 101, 102, 200}.isdisjoint(near) and set(range(60)) <= near and set(range(300, 312)) <= near
    assert ids["mixing to target weights"] <= near
    mixed, packed = kept["mixing to target weights"], kept["packing"]
    assert packed.where("piece = 0").count() == mixed.count()
    assert all(r["n_chars"] == len(r["text"]) for r in mixed.collect())


def test_stages_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for _, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert set(oracles.oracle_sql()) <= set(queries.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", oracles.oracle_sql())
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    out = queries.queries()[name](spark, DATA)
    want = con.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(out.columns)
    assert sorted(map(tuple, out.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
