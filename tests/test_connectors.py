import json
import random

import pytest
from pyspark.sql import functions as F

from rivulet.errors import ParseError, PlanError
from rivulet.sources.connectors import dedup, fill_key, load_config, read_ndjson, transform, write_ndjson
from rivulet.sources.connectors import registry as R
from rivulet.sources.connectors import schema, sql
from rivulet.sources.connectors.pipeline import Exhausted, Outcome, Retry, SinkRunner, SourceRunner
from rivulet.sources.envelope import to_stream
from rivulet.sources.log import Log


def stream(spark, payloads, keys=None):
    rows = [(k, p, (keys or [None] * len(payloads))[k]) for k, p in enumerate(payloads)]
    return to_stream(spark.createDataFrame(rows, "i long, p string, k string"), offset="i", timestamp=F.timestamp_seconds("i"), subject=F.lit("a.b"), key="k", payload="p")


def test_schema_binding(spark):
    good = '{"n": 1, "d": 2.5, "t": "x", "b": true, "at": "2024-01-01T00:00:00Z", "j": {"a": 1}}'
    bad = [("n", '"1"'), ("n", "1.5"), ("d", '"2"'), ("t", "true"), ("b", '"true"'), ("at", '"yesterday"'), ("n", "null")]
    docs = [good, *[json.dumps(json.loads(good) | {k: json.loads(v)}) for k, v in bad], "nope", "[1]", '{"n": 1}']
    out = schema.bind(stream(spark, docs), "n:bigint, d:double, t:text, b:boolean, at:timestamptz, j:jsonb, o:text?").orderBy("offset").collect()
    assert out[0]["error"] is None and (out[0]["n"], out[0]["d"], out[0]["t"], out[0]["b"], json.loads(out[0]["j"]), out[0]["o"]) == (1, 2.5, "x", True, {"a": 1}, None)
    assert all(r["error"] for r in out[1:])
    assert out[7]["error"] == "missing: n" and out[8]["error"] == "payload is not JSON" and out[9]["error"] == "payload is no object" and out[10]["error"] == "missing: d"
    for wrong in ("a", "a:int", "a:text,A:text", "1a:text"):
        with pytest.raises(ParseError):
            schema.parse(wrong)


def test_transform_dedup_key_field(spark):
    rows = stream(spark, ['{"a": 1, "b": "x"}', '{"a": 5, "b": "y"}', '{"a": 5, "b": "y"}'])
    out = transform(rows, "SELECT payload->>'b' AS b, key WHERE payload->>'a' > 2").collect()
    assert [json.loads(r["payload"]) for r in out] == [{"b": "y"}] * 2
    assert transform(rows, "SELECT * WHERE payload->>'a' > 2").count() == 2 and transform(rows, "SELECT *").collect() == rows.collect()
    assert sorted(r["offset"] for r in dedup(rows).collect()) == [0, 1]
    assert [r["key"] for r in fill_key(rows, "b").orderBy("offset").collect()] == ["x", "y", "y"]
    with pytest.raises(PlanError):
        transform(rows, "SELECT a FROM s")


def test_config():
    text = '[connector]\nname = "n"\ntype = "sink"\nplugin = "http_sink"\nstream = "s"\n[settings]\nurl = "${URL}"\n[retry]\nmax_attempts = 2\non_exhausted = "dlq_batch"\n'
    c = load_config(text, {"URL": "http://x"})
    assert c.settings["url"] == "http://x" and c.retry.attempts == 2 and c.exhausted is Exhausted.DLQ_BATCH
    for bad, env in ((text, {}), ("[connector]\n", {}), ("nonsense", {})):
        with pytest.raises(ParseError):
            load_config(bad, env)


def test_retry_delays_stay_below_their_limits():
    r = Retry(attempts=12)
    waits = list(r.delays(random.Random(1)))
    assert len(waits) == 11 and all(0 <= w <= min(0.1 * 2**k, 30) for k, w in enumerate(waits))


@pytest.mark.parametrize("name, upsert", [
    ("postgres", 'INSERT INTO "t" ("k", "v") VALUES ($1, $2) ON CONFLICT ("k") DO UPDATE SET "v" = excluded."v"'),
    ("sqlite", 'INSERT INTO "t" ("k", "v") VALUES (?, ?) ON CONFLICT ("k") DO UPDATE SET "v" = excluded."v"'),
    ("mysql", "INSERT INTO `t` (`k`, `v`) VALUES (?, ?) ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)"),
    ("mssql", "MERGE [t] WITH (HOLDLOCK) AS t USING (SELECT @P1 AS [k], @P2 AS [v]) AS s ON t.[k] = s.[k] WHEN MATCHED THEN UPDATE SET t.[v] = s.[v] WHEN NOT MATCHED THEN INSERT ([k], [v]) VALUES (s.[k], s.[v]);"),
])
def test_sql_text(name, upsert):
    d, fields = sql.Dialect(name), schema.parse("k:bigint,v:text?")
    assert d.upsert("t", fields, ["k"]) == upsert
    assert d.create("t", fields, ["k"]).endswith(f"PRIMARY KEY ({d.quote('k')}))")
    assert d.quote('a"b`c]d')[1:-1] != 'a"b`c]d'
    assert ("TOP (5)" in d.poll("t", ["k"], "k", 5)) == (name == "mssql")
    assert [sql.classify(s) for s in ("23505", "22001", "08006", None)] == ["duplicate", "poison", "transient", "transient"]


def test_sqlite_runs_the_text():
    import sqlite3

    d, fields = sql.Dialect("sqlite"), schema.parse("k:bigint,v:text?")
    db = sqlite3.connect(":memory:")
    db.execute(d.create("t", fields, ["k"]))
    for v in ("a", "b"):
        db.execute(d.upsert("t", fields, ["k"]), (1, v))
    db.execute(d.insert("t", fields), (2, None))
    assert db.execute(d.poll("t", ["k", "v"], "k", 5), (0,)).fetchall() == [(1, "b"), (2, None)]


def test_sources(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    land = tmp_path / "land"
    land.mkdir()
    (land / "1.json").write_text('{"type": "t1", "id": 7}\n{"id": 8}\n')
    c = load_config(json.dumps({"connector": {"name": "w", "type": "source", "plugin": "http_webhook", "stream": "s", "key_field": "id"}, "settings": {"path": str(land), "subject": "hook.{$.type}"}}))
    run = SourceRunner(log, c)
    assert run.poll() == 2 and run.poll() == 0
    assert sorted((r["subject"], r["key"]) for r in log.read("s").collect()) == [("hook.t1", "7"), ("hook.unknown", "8")]
    spark.createDataFrame([(1, "order", "9", "made", "{}"), (2, "order", "9", "paid", "{}")], "id long, aggregate_type string, aggregate_id string, event_type string, payload string").write.parquet(str(tmp_path / "outbox"))
    c = load_config(json.dumps({"connector": {"name": "o", "type": "source", "plugin": "postgres_outbox", "stream": "o"}, "settings": {"url": str(tmp_path / "outbox"), "batch_size": 1}}))
    run = SourceRunner(log, c)
    assert [run.poll() for _ in range(3)] == [1, 1, 0]
    assert sorted((r["subject"], r["key"]) for r in log.read("o").collect()) == [("order.made", "9"), ("order.paid", "9")]


def test_http_poll(spark):
    answers = [(200, {"ETag": "e1"}, b'{"d": {"items": [{"a": 1}, {"a": 2}]}}'), (304, {}, b"")]
    seen = []
    p = R.HttpPoll(spark, {"url": "u", "items_path": "$.d.items", "key_path": "$.a"}, lambda url, body, headers, method, t: (seen.append(headers), answers.pop(0))[1])
    rows, cursor = p.poll(None)
    assert sorted(r["key"] for r in rows.collect()) == ["1", "2"] and cursor["etag"] == "e1"
    assert p.poll(cursor) == (None, cursor) and seen[1] == {"If-None-Match": "e1"}
    with pytest.raises(ParseError):
        R.items_at({"a": 1}, "$.b")


@pytest.mark.parametrize("url, exhausted, delivered, dead, again", [("http://x/4", "loop_forever", 2, 1, 0), ("http://x/5", "loop_forever", 0, 0, 0), ("http://x/5", "dlq_batch", 0, 3, 0)])
def test_http_sink_outcomes(spark, tmp_path, monkeypatch, url, exhausted, delivered, dead, again):
    def _answer(url, body, headers, method, timeout):
        return {"1": 200, "4": 404, "5": 500}[url.rsplit("/")[-1] if b"bad" in body else "1"], {}, b""

    log = Log(spark, str(tmp_path))
    log.append("s", stream(spark, ['{"x": "ok"}', '{"x": "bad"}', '{"x": "fine"}']).drop("offset"))
    monkeypatch.setitem(R.SINKS, "http_sink", lambda s, settings: R.HttpSink(s, settings, _answer))
    c = load_config(json.dumps({"connector": {"name": "h", "type": "sink", "plugin": "http_sink", "stream": "s"}, "settings": {"url": url}, "retry": {"max_attempts": 2, "on_exhausted": exhausted}}))
    sink = SinkRunner(log, c, sleep=lambda s: None)
    assert sink.run() == delivered
    assert (log.read("s-dlq").count() if log.exists("s-dlq") else 0) == dead
    assert sink.run() == again


def test_typed_jdbc_sink(spark):
    saved = []
    sink = R.JdbcSink(spark, {"table": "t", "schema": "a:bigint"}, save=lambda rows, table: saved.append(sorted(r["a"] for r in rows.collect())))
    good, bad, outcome, _ = sink.write(stream(spark, ['{"a": 1}', '{"a": "x"}']))
    assert (good, bad.count(), outcome, saved) == (1, 1, Outcome.POISON, [[1]])

    def fails(rows, table):
        raise RuntimeError("connection lost (SQLSTATE: 08006)")

    assert R.JdbcSink(spark, {"table": "t"}, save=fails).write(stream(spark, ["{}"]))[2] is Outcome.TRANSIENT


@pytest.mark.parametrize("mode", ["upsert", "insert"])
def test_jdbc_sink_moves_staged_rows(spark, mode):
    """A database behind `save` and `execute`: a batch that is sent again, or that repeats keys, loses nothing."""
    import sqlite3

    db = sqlite3.connect(":memory:", check_same_thread=False)

    def save(rows, table):
        names = rows.columns
        db.executemany(f"INSERT INTO {table} ({', '.join(names)}) VALUES ({', '.join('?' * len(names))})", [tuple(r) for r in rows.collect()])

    settings = {"table": "t", "schema": "id:bigint,name:text?", "key": "id", "database": "sqlite", "mode": mode}
    sink = R.JdbcSink(spark, settings, db.execute, save)
    assert sink.write(stream(spark, ['{"id": 1, "name": "a"}', '{"id": 2, "name": "b"}']))[::2] == (2, Outcome.SUCCESS)
    good, bad, outcome, _ = sink.write(stream(spark, ['{"id": 2, "name": "new"}', '{"id": 3, "name": "old"}', '{"id": 3, "name": "c"}', '{"id": "x"}']))
    assert (good, bad.count(), outcome) == (3, 1, Outcome.POISON)
    assert sorted(db.execute("SELECT id, name FROM t")) == [(1, "a"), (2, "new" if mode == "upsert" else "b"), (3, "c")]
    assert [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")] == ["t"]


def test_jdbc_sink_without_sql_sends_refused_batches_to_the_dead_letters(spark):
    def refuses(rows, table):
        raise RuntimeError("duplicate key (SQLSTATE: 23505)")

    good, bad, outcome, _ = R.JdbcSink(spark, {"table": "t"}, save=refuses).write(stream(spark, ["{}", "{}"]))
    assert (good, bad.count(), outcome, bad.first()["reason"]) == (0, 2, Outcome.POISON, "duplicate")


def test_capture_tables_have_binary_positions(spark, tmp_path):
    rows = [(bytes([0] * 9 + [k]), 2, k, f"n{k}") for k in (1, 5, 200)]
    path = str(tmp_path / "c")
    spark.createDataFrame(rows, "`__$start_lsn` binary, `__$operation` int, id long, name string").write.parquet(path)
    source = R.CaptureTable(spark, {"url": path, "table": "people", "batch_size": 2})
    first, cursor = source.poll(None)
    assert first.count() == 2 and cursor == "0" * 18 + "05"
    rest, cursor = source.poll(cursor)
    assert [json.loads(r["payload"])["id"] for r in rest.collect()] == [200] and cursor.endswith("C8")
    assert source.poll(cursor) == (None, cursor)


def test_ndjson_files_follow_the_records(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(0, 2000, 1, 4).selectExpr("id * 64000 AS offset", "timestamp_seconds((id % 20) * 3600) AS at", "'p' AS p")
        calm = to_stream(rows, offset="offset", timestamp="at", key="offset", payload="p")
        busy = calm.withColumn("timestamp", F.timestamp_seconds(F.lit(0)))
        for name, records, hours in (("calm", calm, 20), ("busy", busy, 1)):
            at = str(tmp_path / name)
            write_ndjson(records, at, 100)
            files = list((tmp_path / name).rglob("*.json"))
            # An hour's last file may be short, and a task may end inside an hour.
            assert len(files) <= max(hours, 2000 // 100) + 4
            assert all(len(f.read_text().splitlines()) <= 100 for f in files)
            got, want = read_ndjson(spark, at).select(records.columns), records
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert len({f.name.split("-")[1] for f in files}) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
