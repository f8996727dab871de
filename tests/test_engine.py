import json

import pytest
from pyspark.sql import functions as F

from rivulet.errors import PlanError, StorageError, Unsupported
from rivulet.plans.engine import Engine


def orders(spark, n=5, start=0, at="2024-01-01 00:00:00"):
    rows = [(i, json.dumps({"total": (i + 1) * 100, "region": "eu" if i % 2 == 0 else "us"}), f"ord-{i}", f"order.{'eu' if i % 2 == 0 else 'us'}.created") for i in range(start, start + n)]
    return spark.createDataFrame(rows, "i int, payload string, key string, subject string").withColumn("timestamp", F.expr(f"timestamp'{at}' + make_dt_interval(0, 0, i, 0)"))


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.publish("orders", orders(spark))
    return e


def rows(engine, sql):
    return [tuple(r) for r in engine.query(sql)["rows"]]


def test_bounded(engine):
    assert rows(engine, "SELECT COUNT(*) AS n FROM orders") == [(5,)]
    assert rows(engine, "SELECT payload->>'region' AS r, SUM((payload->>'total')::numeric) AS t FROM orders GROUP BY payload->>'region' ORDER BY t DESC") == [("eu", 900.0), ("us", 600.0)]
    assert rows(engine, "SELECT offset FROM orders WHERE subject = 'order.us.created' ORDER BY offset") == [(1,), (3,)]
    assert rows(engine, "SELECT offset FROM orders ORDER BY offset DESC LIMIT 2") == [(4,), (3,)]
    assert rows(engine, "SELECT 1") == [(1,)]
    assert rows(engine, "SELECT COUNT(*), SUM(payload->>'total') FROM orders WHERE key = 'none'") == [(0, None)]


def test_result_cap_only_without_a_limit(engine, spark):
    engine.register("big", spark.range(15_000).withColumnRenamed("id", "i"))
    assert engine.query("SELECT i FROM big")["row_count"] == 10_000
    assert engine.query("SELECT i FROM big LIMIT 12000")["row_count"] == 12_000


def test_errors(engine):
    assert json.loads(engine.answer("SELECT nope FROM orders"))["error"] == "PLAN_ERROR"
    assert json.loads(engine.answer("SELECT (1"))["error"] == "PARSE_ERROR"
    assert json.loads(engine.answer("SELECT * FROM nothing"))["error"] == "PLAN_ERROR"
    assert json.loads(engine.answer("DELETE FROM orders"))["error"] == "UNSUPPORTED"
    with pytest.raises(Unsupported):
        engine.sql("CREATE VIEW v AS SELECT 1")


def test_scan_pushes_filters_and_prunes_columns(engine):
    plan = engine.sql("SELECT key FROM orders WHERE offset >= 2 AND key = 'ord-3'")._jdf.queryExecution().toString()
    scan = plan[plan.rindex("FileScan") :]
    assert "GreaterThanOrEqual(offset,2)" in scan and "EqualTo(key,ord-3)" in scan
    assert "ReadSchema: struct<offset:bigint,key:string>" in scan


def test_top_n_is_fused(engine):
    assert "TakeOrderedAndProject" in engine.sql("SELECT offset FROM orders ORDER BY offset DESC LIMIT 2")._jdf.queryExecution().executedPlan().toString()


def test_external_tables(engine, spark, tmp_path):
    spark.createDataFrame([(0, "zero"), (1, "one")], "id long, name string").write.parquet(str(tmp_path / "db/people.parquet"))
    engine.connect("db", "parquet", str(tmp_path / "db"))
    for table in ("db.people", "external('db', 'people')"):
        got = rows(engine, f"SELECT o.key, c.name FROM orders o LEFT JOIN {table} c ON o.offset::text = c.id::text ORDER BY o.offset LIMIT 3")
        assert got == [("ord-0", "zero"), ("ord-1", "one"), ("ord-2", None)]
    assert engine.connections() == {"db": {"driver": "parquet"}}
    engine.disconnect("db")
    with pytest.raises(PlanError):
        engine.sql("SELECT * FROM db.people")
    with pytest.raises(Unsupported):
        engine.connect("x", "nosuch", "url")


def test_indexes(engine, spark):
    engine.execute("CREATE INDEX by_region ON orders(payload->>'region')")
    engine.publish("orders", orders(spark, 5, 5))
    assert sorted(r["offset"] for r in engine.index_lookup("by_region", "eu").collect()) == [0, 2, 4, 6, 8] or engine.index_lookup("by_region", "eu").count() == 5
    engine.refresh_index("by_region")
    assert engine.index_lookup("by_region", "us").count() == 5
    with pytest.raises(StorageError):
        engine.execute("CREATE INDEX by_region ON orders(payload->>'region')")
    engine.execute("DROP INDEX by_region")
    with pytest.raises(StorageError):
        engine.index_lookup("by_region", "eu")


def run(engine, sql, **options):
    q = engine.continuous.create(sql, **options)
    engine.continuous.wait(q)
    return q


def payloads(engine, stream):
    return sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in rows(engine, f"SELECT payload FROM {stream}"))


def test_continuous_filter_and_resume(engine, spark):
    q = run(engine, "CREATE VIEW eu AS SELECT key, payload->>'total' AS total FROM orders WHERE payload->>'region' = 'eu' EMIT CHANGES")
    assert len(payloads(engine, "eu")) == 3
    engine.publish("orders", orders(spark, 5, 5))
    engine.continuous.resume(q)
    engine.continuous.wait(q)
    assert len(payloads(engine, "eu")) == 5  # 6 and 8 are new, nothing twice
    assert sorted(r[0] for r in rows(engine, "SELECT key FROM eu")) == ["ord-0", "ord-2", "ord-4", "ord-6", "ord-8"]
    engine.continuous.stop(q)
    assert engine.continuous.list()[q]["status"] == "stopped"
    engine.continuous.remove(q)
    assert not engine.continuous.list()


def test_emit_final_and_late_records(engine, spark):
    q = run(engine, "CREATE VIEW f AS SELECT TUMBLE(timestamp, INTERVAL '2 minutes') AS w, COUNT(*) AS n FROM orders GROUP BY w EMIT FINAL", grace="1 minutes")
    first = payloads(engine, "f")
    assert [json.loads(p)["n"] for p in first] == [2]  # the window from 00:00 is closed by the record of 00:04
    engine.publish("orders", orders(spark, 1, 0))  # late: its window is gone
    engine.publish("orders", orders(spark, 1, 0, "2024-01-01 05:00:00"))
    for _ in range(2):
        engine.continuous.resume(q)
        engine.continuous.wait(q)
    got = {json.loads(p)["w"]: json.loads(p)["n"] for p in payloads(engine, "f")}
    assert sorted(got.values()) == [1, 2, 2] and len(got) == 3


def test_views_merge_by_key_and_survive(engine, spark, tmp_path):
    q = run(engine, "CREATE MATERIALIZED VIEW c AS SELECT payload->>'region' AS region, COUNT(*) AS n FROM orders GROUP BY 1")
    assert sorted(rows(engine, "SELECT * FROM c")) == [("eu", 3), ("us", 2)]
    engine.publish("orders", orders(spark, 1, 6))
    other = Engine(spark, engine.root)  # another process over the same folder
    other.continuous.resume(q)
    other.continuous.wait(q)
    assert sorted(rows(other, "SELECT * FROM c")) == [("eu", 4), ("us", 2)]
    assert [tuple(r) for r in other.views.lookup("c", "eu").collect()] == [("eu", 4)]


def test_stream_stream_join_checks_the_distance(engine, spark):
    engine.publish("pay", orders(spark, 3, 1).withColumn("timestamp", F.expr("timestamp + make_dt_interval(0, 0, i * 5, 0)")))
    run(engine, "CREATE VIEW j AS SELECT o.key AS k, p.payload->>'total' AS t FROM orders o JOIN pay p ON o.key = p.key WITHIN '10 minutes'")
    assert sorted(json.loads(p)["k"] for p in payloads(engine, "j")) == ["ord-1", "ord-2"]


def test_continuous_rejects_what_has_no_meaning(engine):
    with pytest.raises(Unsupported):
        engine.continuous.create("CREATE VIEW v AS SELECT key FROM orders ORDER BY key")
    engine.register("static", engine.spark.range(3))
    with pytest.raises(PlanError):
        engine.continuous.create("CREATE VIEW v AS SELECT id FROM static")


def test_sql_uses_an_index(engine, spark):
    text = "SELECT key FROM orders o WHERE o.payload->>'region' = 'eu' AND payload->>'total' > 100 ORDER BY offset"
    plain = rows(engine, text)
    engine.execute("CREATE INDEX by_region ON orders(payload->>'region')")
    plan = lambda t: engine.sql(t)._jdf.queryExecution().executedPlan().toString()
    assert rows(engine, text) == plain and len(plain) == 2
    # Offsets reach the scan; records after the index are sought by their offsets as well.
    assert "In(offset, [0,2,4])" in plan(text) and "GreaterThanOrEqual(offset,5)" in plan(text)
    engine.publish("orders", orders(spark, 5, 5))
    assert len(rows(engine, text)) == len(plain) + len([k for k in range(5, 10) if k % 2 == 0])
    for other in ("SELECT key FROM orders WHERE payload->>'region' = 'eu' OR key = 'ord-1'", "SELECT key FROM orders WHERE NOT payload->>'region' = 'eu'", "SELECT key FROM orders WHERE payload->>'region' IN ('eu')"):
        assert "In(offset" not in plan(other)
    assert sorted(rows(engine, "SELECT key FROM orders WHERE payload->>'region' = 'eu' OR key = 'ord-1'"))[1] == ("ord-1",)


def test_many_hits_of_an_index_are_joined(engine, monkeypatch):
    from rivulet.plans import engine as module

    text = "SELECT key FROM orders WHERE 'eu' = payload->>'region' ORDER BY offset"
    plain = rows(engine, text)
    engine.execute("CREATE INDEX by_region ON orders(payload->>'region')")
    monkeypatch.setattr(module, "SOUGHT", 2)
    assert rows(engine, text) == plain and "LeftSemi" in engine.sql(text)._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["offset"] for r in engine.index_lookup("by_region", "eu").collect()) == [0, 2, 4]


def test_an_index_knows_of_truncations(engine, spark):
    text = "SELECT key FROM orders WHERE payload->>'region' = 'us' ORDER BY offset"
    engine.execute("CREATE INDEX by_region ON orders(payload->>'region')")
    engine.log.truncate("orders", 2)
    engine.publish("orders", orders(spark, 5, 7))  # now us stands at other offsets
    want = sorted(r["key"] for r in engine.relation("orders").where("get_json_object(payload, '$.region') = 'us'").collect())
    assert sorted(r[0] for r in rows(engine, text)) == want
    engine.refresh_index("by_region")
    assert sorted(r[0] for r in rows(engine, text)) == want
    engine.execute("DROP STREAM orders")
    with pytest.raises(StorageError):
        engine.index_lookup("by_region", "us")
