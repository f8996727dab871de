import pytest
from pyspark.sql import functions as F

from rivulet.errors import StorageError
from rivulet.sources.consumers import Consumer, routed
from rivulet.sources.log import Log, StreamConfig, valid_name


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, str(tmp_path))


def records(spark, n, start=0):
    df = spark.range(start, start + n)
    return df.select(F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("timestamp"), F.concat(F.lit("s."), F.col("id") % 3).alias("subject"), F.col("id").cast("string").alias("key"), F.to_json(F.struct("id")).alias("payload"))


def test_offsets_are_dense_and_follow_the_order(log, spark):
    assert log.append("s", records(spark, 100)) == (0, 100)
    assert log.append("s", records(spark, 50, 100)) == (100, 150)
    rows = log.read("s").orderBy("offset").collect()
    assert [r["offset"] for r in rows] == list(range(150)) and [r["key"] for r in rows] == [str(i) for i in range(150)]
    assert log.append("s", records(spark, 0)) == (150, 150)


def test_empty_stream_and_names(log):
    log.create("empty")
    assert log.read("empty").count() == 0 and log.bounds("empty") == (0, 0)
    for bad in ("", "a.b", "x" * 256, "a b"):
        with pytest.raises(StorageError):
            valid_name(bad)
    with pytest.raises(StorageError):
        log.read("none")
    log.delete("empty")
    log.delete("empty")
    assert not log.exists("empty")


def test_trim_truncate_fetch_seek(log, spark):
    log.append("s", records(spark, 30))
    log.append("s", records(spark, 30, 30))
    log.trim("s", 35)
    log.truncate("s", 50)
    assert log.bounds("s") == (35, 50)
    assert sorted(r["offset"] for r in log.read("s").collect()) == list(range(35, 50))
    assert log.append("s", records(spark, 5, 60)) == (50, 55)
    assert [r["offset"] for r in log.read("s").orderBy("offset").collect()] == list(range(35, 55))
    assert [r["offset"] for r in log.fetch("s", 36, 3, "s.0").collect()] == [36, 39, 42]
    assert log.seek("s", F.timestamp_seconds(F.lit(1_700_000_040))) == 40
    assert log.seek("s", F.timestamp_seconds(F.lit(1_900_000_000))) == 55
    assert [r["offset"] for r in log.tail("s", 2).collect()] == [54, 53]


def test_retention_drops_whole_old_segments_but_never_the_last(log, spark):
    log.create("s", StreamConfig(max_age_secs=1000))
    for k in range(3):
        log.append("s", records(spark, 10, k * 10_000))
    assert log.retain("s", now=1_700_000_000 + 10_500) == 1
    assert log.bounds("s") == (10, 30)
    assert log.retain("s", now=2_000_000_000) == 1
    assert log.bounds("s") == (20, 30)
    log.create("s", StreamConfig(max_bytes=1))
    assert log.retain("s") == 0


def test_config():
    assert StreamConfig(max_age_secs=0).max_age_secs == 604_800
    with pytest.raises(StorageError):
        StreamConfig(max_age_secs=10, dedup_window_secs=20)


def test_idempotent_publish(log, spark):
    first = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "1"), ("b", "2"), (None, "z"), (None, "z")], "msg_id string, payload string")
    got = sorted((r["msg_id"] or "", r["status"]) for r in log.publish("s", first).collect())
    assert got[:2] == [("", "written")] * 2 and sorted(got[2:4]) == [("a", "duplicate"), ("a", "written")] and sorted(got[4:]) == [("b", "collision"), ("b", "written")]
    assert log.bounds("s") == (0, 4)
    again = spark.createDataFrame([("a", "1"), ("a", "other"), ("c", "n")], "msg_id string, payload string")
    rows = {(r["msg_id"], r["status"]): r["offset"] for r in log.publish("s", again).collect()}
    assert set(rows) == {("a", "duplicate"), ("a", "collision"), ("c", "written")} and rows["c", "written"] == 4
    late = log.publish("s", again.limit(1), now=F.current_timestamp() + F.expr("INTERVAL 1 HOUR")).collect()
    assert late[0]["status"] == "written"  # the window is over


def test_two_writers_do_not_both_win(log):
    log.create("s")
    v = log._versions("s")
    n, state = v.load()
    v.save(n, state)
    with pytest.raises(StorageError):
        v.save(n, state)


def test_consumers(log, spark):
    log.append("s", records(spark, 10))
    c = Consumer(log, "c", "s", subject="s.1")
    assert [r["offset"] for r in c.poll(2).collect()] == [1, 4]
    c.ack(1)
    c.ack(0)
    assert c.offset == 2 and Consumer(log, "c", "s").offset == 2
    assert [c.nack(4) for _ in range(5)] == [False] * 4 + [True]
    assert c.offset == 5
    dead = log.read("s-dlq").collect()
    assert len(dead) == 1 and dead[0]["headers"]["x-original-offset"] == "4" and dead[0]["headers"]["x-failure-count"] == "5"
    assert Consumer(log, "late", "s", start="latest").offset == 10 and Consumer(log, "at", "s", start="2023-11-14 22:13:25").offset == 5
    members = routed(log.read("s"), 3).groupBy("key").agg(F.countDistinct("member").alias("n")).where("n > 1").count()
    assert members == 0


def test_an_append_is_whole_or_not_there(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    rows = spark.range(10).select(F.col("id").cast("string").alias("payload"))
    log.append("s", rows)
    # The writer dies before the commit: the next one starts where the last commit ended.
    place, save = log._place, log._versions
    log._place = lambda segment: None
    log.append("s", rows)  # committed, but not moved to its place
    log._place = place
    assert len(log.files.names(f"{tmp_path}/streams/s/segments")) == 1
    other = Log(spark, str(tmp_path))
    assert other.read("s").count() == 20 and other.bounds("s") == (0, 20)
    assert len(log.files.names(f"{tmp_path}/streams/s/segments")) == 2 and save("s").load()[0] > 0


def test_a_marked_append_happens_once(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    rows = spark.range(3).select(F.col("id").cast("string").alias("payload"))
    assert log.append("s", rows, mark=("q", 0)) == (0, 3) and log.append("s", rows, mark=("q", 0)) == (3, 3)
    assert log.append("s", rows.limit(0), mark=("q", 1)) == (3, 3) and log.marked("s", "q") == 1
    assert log.append("s", rows, mark=("q", 2)) == (3, 6) and log.append("s", rows, mark=("r", 0)) == (6, 9)
