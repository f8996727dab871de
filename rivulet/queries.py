"""Queries over the driver's tables, one or more for each operator, with their DuckDB equivalents.

Most are text in the dialect, run as a user would run them; the rest use operators, the log or streaming directly.
Streams: events (subject events.<type>, key user, payload {type, value, k}), orders, clicks and purchases.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet import operators as ops
from rivulet.plans.engine import Engine
from rivulet.session import checkpoint_dir
from rivulet.sources.connectors import dedup, dlq, read_ndjson, schema, transform, write_ndjson
from rivulet.sources.consumers import dead_letters, routed
from rivulet.sources.envelope import to_stream
from rivulet.streaming.continuous import stream_changelog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """A folder of the shared checkpoint folder for what a query writes."""
    return f"{checkpoint_dir(spark)}/engine-{uuid.uuid4().hex}"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(source: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    payload = F.to_json(F.struct(F.col("event_type").alias("type"), "value", k.alias("k")))
    return to_stream(source, offset="event_id", timestamp="ts", subject=F.concat(F.lit("events."), F.col("event_type"), F.lit(".u"), F.col("user_id")), key="user_id", payload=payload)


def orders(source: DataFrame) -> DataFrame:
    payload = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total"), F.col("o_custkey").alias("customer_id")))
    headers = F.create_map(F.lit("x-source"), F.lit("orders"), F.lit("x-status"), F.col("o_orderstatus"))
    return to_stream(source, offset="o_orderkey", timestamp="o_orderdate", subject=F.concat(F.lit("order."), "o_orderstatus"), key="o_custkey", payload=payload, headers=headers)


def engine(spark: SparkSession, d: str) -> Engine:
    """An engine whose relations are the tables of a folder: events and orders as streams, the others as the tables
    of the external database `warehouse`."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = Engine(spark, _root(spark))
    e.register("events", lambda: events(_table(spark, d, "events")))
    e.register("orders", lambda: orders(_table(spark, d, "orders")))
    for kind in ("click", "purchase"):
        e.register(f"{kind}s", lambda kind=kind: events(_table(spark, d, "events").where(F.col("event_type") == kind)))
    for t in ("customer", "nation", "region", "supplier", "part", "lineitem"):
        e.register(f"warehouse.{t}", lambda t=t: _table(spark, d, t))
    return e


def _sql(name: str, text: str, oracle: str) -> None:
    QUERIES[name] = lambda spark, d: engine(spark, d).sql(text)
    ORACLES[name] = oracle


def _op(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


#: The events stream in DuckDB.
_EV = "(SELECT event_id AS \"offset\", ts, 'events.' || event_type || '.u' || user_id AS subject, CAST(user_id AS VARCHAR) AS key, event_type AS type, value, CAST(props->>'k' AS BIGINT) AS k FROM events)"

# -- scans, filters, projections, limits ----------------------------------------------------------------------------
_sql("json_group_revenue", "SELECT payload->>'type' AS type, ROUND(SUM((payload->>'value')::numeric), 2) AS revenue, COUNT(*) AS event_count FROM events GROUP BY payload->>'type' ORDER BY revenue DESC",
     f"SELECT type, round(sum(value), 2) AS revenue, count(*) AS event_count FROM {_EV} GROUP BY type")
_sql("scan_full", "SELECT offset, subject, key, payload->>'k' AS k FROM events", f"SELECT \"offset\", subject, key, CAST(k AS VARCHAR) AS k FROM {_EV}")
_sql("scan_limit", "SELECT offset, key, subject FROM events ORDER BY offset LIMIT 5", f"SELECT \"offset\", key, subject FROM {_EV} ORDER BY \"offset\" LIMIT 5")
_sql("scan_offsets", "SELECT offset FROM events ORDER BY offset LIMIT 1000", f"SELECT \"offset\" FROM {_EV} ORDER BY \"offset\" LIMIT 1000")
_sql("filter_json_eq", "SELECT offset, payload->>'k' AS k FROM events WHERE payload->>'type' = 'click'", f"SELECT \"offset\", CAST(k AS VARCHAR) AS k FROM {_EV} WHERE type = 'click'")
_sql("filter_json_limit", "SELECT offset, payload->>'k' AS k FROM events WHERE payload->>'type' = 'purchase' ORDER BY offset LIMIT 100", f"SELECT \"offset\", CAST(k AS VARCHAR) AS k FROM {_EV} WHERE type = 'purchase' ORDER BY \"offset\" LIMIT 100")
_sql("filter_json_number", "SELECT offset FROM events WHERE payload->>'k' >= 50 AND (payload->>'value')::DECIMAL < 100", f"SELECT \"offset\" FROM {_EV} WHERE k >= 50 AND value < 100")
_sql("filter_key", "SELECT offset, subject FROM events WHERE key = '7'", f"SELECT \"offset\", subject FROM {_EV} WHERE key = '7'")
_sql("project_star_columns", "SELECT e.key, e.offset, UPPER(e.payload->>'type') FROM events e", f"SELECT key, \"offset\", upper(type) AS upper FROM {_EV}")
_sql("project_alias_rules", "SELECT payload->>'k', COUNT(*), CAST(payload->>'k' AS INT) AS n FROM events GROUP BY payload->>'k'", f"SELECT CAST(k AS VARCHAR) AS k, count(*) AS count, k AS n FROM {_EV} GROUP BY k")
_sql("reverse_tail", "SELECT offset, key FROM events ORDER BY offset DESC LIMIT 10", f"SELECT \"offset\", key FROM {_EV} ORDER BY \"offset\" DESC LIMIT 10")
_sql("reverse_tail_filtered", "SELECT offset, key FROM events WHERE payload->>'type' = 'click' ORDER BY offset DESC LIMIT 10 OFFSET 3", f"SELECT \"offset\", key FROM {_EV} WHERE type = 'click' ORDER BY \"offset\" DESC LIMIT 10 OFFSET 3")
_sql("topn_value", "SELECT offset, (payload->>'value')::DOUBLE AS value FROM events ORDER BY value DESC, offset LIMIT 20", f"SELECT \"offset\", value FROM {_EV} ORDER BY value DESC, \"offset\" LIMIT 20")
_sql("sort_multi", "SELECT key, offset, payload->>'type' AS type FROM events ORDER BY type DESC, key, offset LIMIT 50", f"SELECT key, \"offset\", type FROM {_EV} ORDER BY type DESC, key, \"offset\" LIMIT 50")
_sql("limit_offset", "SELECT offset FROM events ORDER BY offset LIMIT 10 OFFSET 25", f"SELECT \"offset\" FROM {_EV} ORDER BY \"offset\" LIMIT 10 OFFSET 25")
_sql("limit_comma", "SELECT offset FROM events ORDER BY offset LIMIT 5, 10", f"SELECT \"offset\" FROM {_EV} ORDER BY \"offset\" LIMIT 10 OFFSET 5")
_sql("sort_negative_numbers", "SELECT c.c_custkey, ROUND(c.c_acctbal, 2) AS bal FROM warehouse.customer c ORDER BY bal, c_custkey LIMIT 20", "SELECT c_custkey, round(c_acctbal, 2) AS bal FROM customer ORDER BY bal, c_custkey LIMIT 20")
# -- expressions ----------------------------------------------------------------------------------------------------
_sql("like_ci", "SELECT offset FROM events WHERE subject LIKE 'EVENTS.C%' AND subject NOT LIKE '%u1'", f"SELECT \"offset\" FROM {_EV} WHERE subject ILIKE 'EVENTS.C%' AND subject NOT ILIKE '%u1'")
_sql("subject_part", "SELECT offset, SUBJECT_PART(subject, 2) AS p2, SUBJECT_PART(subject, 3) AS p3, SUBJECT_PART(subject, 9) AS p9, SUBJECT_PART(subject, 0) AS p0 FROM events",
     f"SELECT \"offset\", string_split(subject, '.')[2] AS p2, string_split(subject, '.')[3] AS p3, CAST(NULL AS VARCHAR) AS p9, CAST(NULL AS VARCHAR) AS p0 FROM {_EV}")
_sql("subject_matches", "SELECT offset, SUBJECT_MATCHES(subject, 'events.*.u1') AS one, SUBJECT_MATCHES(subject, 'events.>') AS tail, SUBJECT_MATCHES(subject, 'events.*') AS short, SUBJECT_MATCHES(subject, '') AS every FROM events",
     f"SELECT \"offset\", regexp_full_match(subject, 'events\\.[^.]*\\.u1') AS one, starts_with(subject, 'events.') AS tail, regexp_full_match(subject, 'events\\.[^.]*') AS short, true AS every FROM {_EV}")
_sql("safe_div_mod", "SELECT offset, payload->>'value' / ((payload->>'k')::INT - 50) AS d, (payload->>'k')::INT % ((payload->>'k')::INT - 50) AS m FROM events",
     f"SELECT \"offset\", CASE WHEN k <> 50 THEN value / (k - 50) END AS d, CASE WHEN k <> 50 THEN k % (k - 50) END AS m FROM {_EV}")
_sql("arithmetic", "SELECT offset, (payload->>'k')::INT * 3 + 2 - -1 AS a, -(payload->>'k')::INT AS b, 7 / 2 AS c FROM events", f"SELECT \"offset\", k * 3 + 2 + 1 AS a, -k AS b, 3.5::DOUBLE AS c FROM {_EV}")
_sql("safe_cast", "SELECT offset, subject::INT AS none, (payload->>'k')::TEXT AS t, CAST(payload->>'value' AS DECIMAL(10,2)) AS v, '12.7'::INT AS bad, (payload->>'k')::BIGINT > 10 AS b FROM events",
     f"SELECT \"offset\", CAST(NULL AS BIGINT) AS none, CAST(k AS VARCHAR) AS t, value AS v, CAST(NULL AS BIGINT) AS bad, k > 10 AS b FROM {_EV}")
_sql("case_when", "SELECT offset, CASE WHEN payload->>'type' = 'click' THEN 1 WHEN payload->>'k' > 50 THEN 2 ELSE 0 END AS c FROM events", f"SELECT \"offset\", CAST(CASE WHEN type = 'click' THEN 1 WHEN k > 50 THEN 2 ELSE 0 END AS INTEGER) AS c FROM {_EV}")
_sql("in_between_null", "SELECT offset, payload->>'type' IN ('click', 'purchase') AS i, (payload->>'k')::INT BETWEEN 10 AND 20 AS b, (payload->>'k')::INT NOT BETWEEN 10 AND 20 AS nb, NULLIF(payload->>'type', 'click') IN ('view', NULL) AS n, payload->>'nope' IS NULL AS z FROM events",
     f"SELECT \"offset\", type IN ('click', 'purchase') AS i, k BETWEEN 10 AND 20 AS b, k NOT BETWEEN 10 AND 20 AS nb, nullif(type, 'click') IN ('view', NULL) AS n, true AS z FROM {_EV}")
_sql("three_valued_logic", "SELECT offset, (NULLIF(payload->>'type', 'click') = 'view') AND (payload->>'k')::INT > 50 AS a, (NULLIF(payload->>'type', 'click') = 'view') OR (payload->>'k')::INT > 50 AS o, NOT (NULLIF(payload->>'type', 'click') = 'view') AS n FROM events",
     f"SELECT \"offset\", (nullif(type, 'click') = 'view') AND k > 50 AS a, (nullif(type, 'click') = 'view') OR k > 50 AS o, NOT (nullif(type, 'click') = 'view') AS n FROM {_EV}")
_sql("json_nested", "SELECT offset, payload->'k' AS j, payload->'type' AS q, payload->'a'->>'b' AS none FROM events", f"SELECT \"offset\", CAST(k AS VARCHAR) AS j, '\"' || type || '\"' AS q, CAST(NULL AS VARCHAR) AS none FROM {_EV}")
_sql("string_fns", "SELECT d.n_nationkey AS nk, UPPER(d.n_name) AS u, LOWER(d.n_name) AS l, LENGTH('é' || d.n_name) AS len, CONCAT(d.n_name, NULL, '-', d.n_nationkey) AS c, SUBSTRING(d.n_name, 0, 3) AS s, SUBSTR(d.n_name, 3) AS r, TRIM('  ' || d.n_name || ' ') AS t FROM warehouse.nation d",
     "SELECT n_nationkey AS nk, upper(n_name) AS u, lower(n_name) AS l, CAST(strlen('é' || n_name) AS BIGINT) AS len, n_name || '-' || n_nationkey AS c, substring(n_name, 1, 3) AS s, substring(n_name, 3) AS r, n_name AS t FROM nation")
_sql("math_fns", "SELECT c.c_custkey AS ck, ABS(c.c_acctbal) AS a, ROUND(c.c_acctbal) AS r, CEIL(c.c_acctbal) AS ce, CEILING(c.c_acctbal) AS c2, FLOOR(c.c_acctbal) AS f FROM warehouse.customer c",
     "SELECT c_custkey AS ck, abs(c_acctbal) AS a, CAST(round(c_acctbal) AS BIGINT) AS r, CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(ceil(c_acctbal) AS BIGINT) AS c2, CAST(floor(c_acctbal) AS BIGINT) AS f FROM customer")
_sql("null_fns", "SELECT offset, COALESCE(payload->>'nope', payload->>'type') AS c, NULLIF(payload->>'type', 'click') AS n FROM events", f"SELECT \"offset\", type AS c, nullif(type, 'click') AS n FROM {_EV}")
_sql("header_fn", "SELECT offset, HEADER('x-status') AS s, HEADER('none') AS n FROM orders", "SELECT o_orderkey AS \"offset\", o_orderstatus AS s, CAST(NULL AS VARCHAR) AS n FROM orders")
_sql("scalar_subquery", "SELECT offset FROM events WHERE (payload->>'value')::DOUBLE > (SELECT AVG((payload->>'value')::DOUBLE) FROM events)", "SELECT event_id AS \"offset\" FROM events WHERE value > (SELECT avg(value) FROM events)")
# -- aggregates -----------------------------------------------------------------------------------------------------
_sql("agg_all", "SELECT payload->>'type' AS type, COUNT(*) AS n, COUNT(payload->>'k') AS nk, ROUND(SUM(payload->>'value'), 2) AS s, ROUND(AVG(payload->>'value'), 6) AS a, MIN(key) AS lo, MAX(offset) AS hi FROM events GROUP BY payload->>'type'",
     f"SELECT type, count(*) AS n, count(k) AS nk, round(sum(value), 2) AS s, round(avg(value), 6) AS a, min(key) AS lo, max(\"offset\") AS hi FROM {_EV} GROUP BY type")
_sql("agg_distinct", "SELECT payload->>'type' AS type, COUNT(DISTINCT key) AS u, SUM(DISTINCT (payload->>'k')::INT) AS s, ROUND(AVG(DISTINCT (payload->>'k')::INT), 6) AS a FROM events GROUP BY payload->>'type'",
     f"SELECT type, count(DISTINCT key) AS u, CAST(sum(DISTINCT k) AS BIGINT) AS s, round(avg(DISTINCT k), 6) AS a FROM {_EV} GROUP BY type")
_sql("agg_global", "SELECT COUNT(*) AS n, ROUND(SUM(payload->>'value'), 2) AS s FROM events", f"SELECT count(*) AS n, round(sum(value), 2) AS s FROM {_EV}")
_sql("agg_global_empty", "SELECT COUNT(*) AS n, SUM(payload->>'value') AS s, MIN(key) AS m FROM events WHERE key = 'nobody'", f"SELECT count(*) AS n, sum(value) AS s, min(key) AS m FROM {_EV} WHERE key = 'nobody'")
_sql("agg_expressions", "SELECT key, ROUND(SUM(payload->>'value') / COUNT(*), 9) AS mean, MAX(offset) - MIN(offset) AS span FROM events GROUP BY key HAVING COUNT(*) > 2", f"SELECT key, round(sum(value) / count(*), 9) AS mean, max(\"offset\") - min(\"offset\") AS span FROM {_EV} GROUP BY key HAVING count(*) > 2")
_sql("group_by_alias_ordinal", "SELECT SUBJECT_PART(subject, 2) AS part, key, COUNT(*) AS n FROM events GROUP BY part, 2", f"SELECT string_split(subject, '.')[2] AS part, key, count(*) AS n FROM {_EV} GROUP BY 1, 2")
_sql("select_distinct", "SELECT DISTINCT payload->>'type' AS type, key FROM events", f"SELECT DISTINCT type, key FROM {_EV}")
# -- time -----------------------------------------------------------------------------------------------------------
_sql("time_range", "SELECT offset FROM events WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00' AND timestamp < TIMESTAMP '2024-01-10 00:00:00' + INTERVAL '2 days'", "SELECT event_id AS \"offset\" FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'")
_sql("time_now_interval", "SELECT offset FROM events WHERE timestamp + INTERVAL '1 hour' < NOW()", "SELECT event_id AS \"offset\" FROM events WHERE ts + INTERVAL 1 HOUR < CAST(now() AS TIMESTAMP)")
_sql("tumbling_count", "SELECT unix_micros(TUMBLING(timestamp, '1 hour')) AS w, COUNT(*) AS n FROM events GROUP BY TUMBLING(timestamp, '1 hour')", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS w, count(*) AS n FROM events GROUP BY 1")
_sql("tumbling_by_key", "SELECT unix_micros(win) AS w, type, n, s FROM (SELECT TUMBLE(timestamp, INTERVAL '1 day') AS win, payload->>'type' AS type, COUNT(*) AS n, ROUND(SUM(payload->>'value'), 2) AS s FROM events GROUP BY win, type) t",
     "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS w, event_type AS type, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY 1, 2")
# -- joins, CTEs, set operations ------------------------------------------------------------------------------------
_sql("inner_join", "SELECT o.offset, c.c_name FROM orders o JOIN warehouse.customer c ON o.payload->>'customer_id' = c.c_custkey::text", "SELECT o_orderkey AS \"offset\", c_name FROM orders JOIN customer ON o_custkey = c_custkey")
_sql("left_join", "SELECT o.offset, c.c_name FROM orders o LEFT JOIN warehouse.customer c ON c.c_custkey::text = o.key AND c.c_acctbal > 5000", "SELECT o_orderkey AS \"offset\", c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000")
_sql("external_lookup_join", "SELECT n.n_name AS nation, COUNT(*) AS orders, ROUND(SUM(o.payload->>'total'), 2) AS total FROM orders o JOIN warehouse.customer c ON o.key = c.c_custkey::text JOIN warehouse.nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
     "SELECT n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_sql("within_join_sql", "SELECT a.offset AS a, b.offset AS b FROM clicks a JOIN purchases b ON a.key = b.key WITHIN '10 minutes'",
     "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000")
_sql("join_time_condition", "SELECT o.offset AS a, p.offset AS b FROM clicks o JOIN purchases p ON o.key = p.key AND p.timestamp BETWEEN o.timestamp AND o.timestamp + INTERVAL '10 minutes'",
     "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 10 MINUTE")
_sql("cte", "WITH c AS (SELECT * FROM events WHERE payload->>'type' = 'click'), n AS (SELECT key, COUNT(*) AS n FROM c GROUP BY key) SELECT key, n FROM n WHERE n > 1", f"WITH n AS (SELECT key, count(*) AS n FROM {_EV} WHERE type = 'click' GROUP BY key) SELECT key, n FROM n WHERE n > 1")
_sql("from_subquery", "SELECT t.type, t.n FROM (SELECT payload->>'type' AS type, COUNT(*) AS n FROM events GROUP BY payload->>'type') t WHERE t.n > 10", f"SELECT type, n FROM (SELECT type, count(*) AS n FROM {_EV} GROUP BY type) WHERE n > 10")
_sql("union_all", "SELECT key FROM clicks UNION SELECT key FROM purchases", "SELECT CAST(user_id AS VARCHAR) AS key FROM events WHERE event_type = 'click' UNION SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'purchase'")
_sql("analytic_window", "SELECT offset, ROW_NUMBER() OVER (PARTITION BY key ORDER BY offset) AS rn, COUNT(*) OVER (PARTITION BY key) AS n FROM events", f"SELECT \"offset\", row_number() OVER (PARTITION BY key ORDER BY \"offset\") AS rn, count(*) OVER (PARTITION BY key) AS n FROM {_EV}")


# -- operators as functions -----------------------------------------------------------------------------------------
@_op("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000")
def within_join(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    a = e.relation("clicks").select(F.col("offset").alias("a"), F.col("key").alias("ka"), F.col("timestamp").alias("ta"))
    b = e.relation("purchases").select(F.col("offset").alias("b"), F.col("key").alias("kb"), F.col("timestamp").alias("tb"))
    return ops.within_join(a, b, [(F.col("ka"), F.col("kb"))], F.col("ta"), F.col("tb"), 600).select("a", "b")


@_op("SELECT o_orderkey AS \"offset\", c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    out = ops.lookup_join(e.relation("orders"), _table(spark, d, "customer"), [(F.col("key"), F.col("c_custkey"))], "left", broadcast_rows=100_000)
    return out.select("offset", "c_mktsegment")


@_op("SELECT event_id AS \"offset\", epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS w, event_type AS type, count(*) OVER p AS n, round(sum(value) OVER p, 2) AS s FROM events WINDOW p AS (PARTITION BY time_bucket(INTERVAL 1 HOUR, ts), event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def emit_changes_changelog(spark: SparkSession, d: str) -> DataFrame:
    rows = engine(spark, d).relation("events")
    rows = rows.select("offset", "timestamp", F.get_json_object("payload", "$.type").alias("type"), F.get_json_object("payload", "$.value").try_cast("double").alias("v"))
    out = ops.changelog(rows, F.col("timestamp"), "1 hour", [F.col("type")], n=F.count("*"), s=F.sum("v"))
    return out.select("offset", F.unix_micros("window_start").alias("w"), "type", "n", F.round("s", 2).alias("s"))


@_op("SELECT CAST(user_id AS VARCHAR) AS key, max(event_id) AS \"offset\", arg_max(event_type, event_id) AS type FROM events GROUP BY user_id")
def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    rows = engine(spark, d).relation("events").select("key", "offset", F.get_json_object("payload", "$.type").alias("type"))
    return ops.latest_by_key(rows, [F.col("key").alias("k")], "offset", ["key", "offset", "type"])


@_op("SELECT epoch_us(w) AS w, type, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2) WHERE w + INTERVAL 1 HOUR + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events)")
def final_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = engine(spark, d).relation("events").select("timestamp", F.get_json_object("payload", "$.type").alias("type"))
    out = ops.final_windows(rows, F.col("timestamp"), "1 hour", [F.col("type")], n=F.count("*"))
    return out.select(F.unix_micros("window_start").alias("w"), "type", "n")


# -- the log --------------------------------------------------------------------------------------------------------
def _logged(spark: SparkSession, d: str, parts: int = 2) -> Engine:
    """Events published to a stream `log`, in `parts` appends by order of their ids."""
    e = engine(spark, d)
    rows = e.relation("events")
    for k in range(parts):
        e.publish("log", rows.where(F.pmod(F.floor(F.col("offset") / 500), F.lit(parts)) == k).withColumn("o", F.col("offset")), order=["o"])
    return e


_DENSE = "(SELECT row_number() OVER (ORDER BY (event_id // 500) % 2, event_id) - 1 AS \"offset\", event_id, ts, user_id, event_type, CAST(props->>'k' AS BIGINT) AS k FROM events)"


@_op(f"SELECT \"offset\", CAST(user_id AS VARCHAR) AS key, CAST(k AS VARCHAR) AS k FROM {_DENSE}")
def publish_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _logged(spark, d).sql("SELECT offset, key, payload->>'k' AS k FROM log")


@_op(f"SELECT \"offset\", CAST(user_id AS VARCHAR) AS key FROM {_DENSE} WHERE \"offset\" >= 100 AND event_type = 'click' ORDER BY \"offset\" LIMIT 50")
def fetch_subject(spark: SparkSession, d: str) -> DataFrame:
    return _logged(spark, d).log.fetch("log", 100, 50, "events.click.>").select("offset", "key")


@_op(f"SELECT min(\"offset\") AS \"offset\" FROM {_DENSE} WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def seek_by_time(spark: SparkSession, d: str) -> DataFrame:
    e = _logged(spark, d)
    return spark.createDataFrame([(e.log.seek("log", F.lit("2024-01-15 00:00:00").cast("timestamp")),)], "offset long")


@_op(f"SELECT count(*) AS n, min(\"offset\") AS lo, max(\"offset\") AS hi FROM {_DENSE} WHERE \"offset\" >= 120 AND \"offset\" < (SELECT count(*) - 80 FROM events)")
def trim_truncate(spark: SparkSession, d: str) -> DataFrame:
    e = _logged(spark, d)
    e.log.trim("log", 120)
    e.log.truncate("log", e.log.bounds("log")[1] - 80)
    return e.sql("SELECT COUNT(*) AS n, MIN(offset) AS lo, MAX(offset) AS hi FROM log")


@_op("WITH d AS (SELECT event_id % 700 AS id, event_id, event_type || CASE WHEN event_id % 3 = 0 THEN 'x' ELSE '' END AS body FROM events), f AS (SELECT id, arg_min(body, event_id) AS first, min(event_id) AS m, row_number() OVER (ORDER BY min(event_id)) - 1 AS o FROM d GROUP BY id) SELECT CAST(id AS VARCHAR) AS msg_id, CASE WHEN event_id = m THEN 'written' WHEN body = first THEN 'duplicate' ELSE 'collision' END AS status, o AS \"offset\" FROM d JOIN f USING (id)")
def publish_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    body = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "x").otherwise(""))
    rows = _table(spark, d, "events").select((F.col("event_id") % 700).cast("string").alias("msg_id"), body.alias("payload"), F.timestamp_micros(F.col("event_id")).alias("timestamp"))
    return e.log.publish("pub", rows).select("msg_id", "status", "offset")


@_op(f"SELECT \"offset\", CAST(user_id AS VARCHAR) AS key FROM {_DENSE} WHERE k = 42")
def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = _logged(spark, d)
    e.execute("CREATE INDEX by_k ON log(payload->>'k')")
    return e.index_lookup("by_k", "42").select("offset", "key")


@_op("SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY user_id")
def consumer_routing(spark: SparkSession, d: str) -> DataFrame:
    """Each key goes to one member: its records, counted where it is routed."""
    rows = routed(engine(spark, d).relation("events"), 4)
    return rows.groupBy("key", "member").agg(F.count("*").alias("n")).select("key", "n")


@_op("SELECT o_orderkey AS \"offset\", CAST(o_orderkey AS VARCHAR) AS origin, '5' AS failures FROM orders WHERE o_orderstatus = 'F'")
def dlq_split(spark: SparkSession, d: str) -> DataFrame:
    rows = engine(spark, d).relation("orders").where(F.col("headers").getItem("x-status") == "F")
    out = dead_letters(rows.withColumn("payload", F.col("offset").cast("string")), "orders", "c", 5)
    h = F.col("headers")
    return out.select(F.col("payload").cast("bigint").alias("offset"), h.getItem("x-original-offset").alias("origin"), h.getItem("x-failure-count").alias("failures"))


# -- connectors -----------------------------------------------------------------------------------------------------
@_op("SELECT o_orderkey AS \"offset\", o_orderstatus AS status, o_totalprice AS total FROM orders WHERE o_totalprice > 100000")
def connector_transform(spark: SparkSession, d: str) -> DataFrame:
    out = transform(engine(spark, d).relation("orders"), "SELECT payload->>'status' AS status, (payload->>'total')::numeric AS total WHERE payload->>'total' > 100000")
    return out.select("offset", F.get_json_object("payload", "$.status").alias("status"), F.get_json_object("payload", "$.total").cast("double").alias("total"))


@_op("SELECT o_orderkey AS \"offset\", o_custkey AS customer_id, o_totalprice AS total, CAST(NULL AS VARCHAR) AS note, CASE WHEN o_orderstatus = 'O' THEN 'missing: reason' END AS error FROM orders")
def typed_sink_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = engine(spark, d).relation("orders")
    shaped = rows.withColumn("payload", F.when(F.col("subject") != "order.O", F.concat(F.expr("substring(payload, 1, length(payload) - 1)"), F.lit(',"reason":"r"}'))).otherwise(F.col("payload")))
    out = schema.bind(shaped, "customer_id:bigint,total:double,note:text?,reason:text")
    return out.select("offset", "customer_id", "total", "note", F.col("error"))


@_op("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS key FROM orders")
def connector_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup(engine(spark, d).relation("orders")).select("key")


@_op("SELECT CAST(o_custkey AS VARCHAR) AS key, strftime(o_orderdate, '%Y/%m/%d/%H') AS folder, epoch_us(o_orderdate) AS at, o_orderstatus AS status, o_totalprice AS total FROM orders")
def ndjson_sink(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_root(spark)}/ndjson"
    write_ndjson(engine(spark, d).relation("orders"), path)
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    folder = F.concat_ws("/", "year", "month", "day", "hour").alias("folder")
    return read_ndjson(spark, path).select("key", folder, F.unix_micros("timestamp").alias("at"), field("status").alias("status"), field("total").cast("double").alias("total"))


@_op("SELECT 'rejected' AS reason, count(*) AS n FROM orders WHERE o_totalprice > 300000")
def connector_dlq(spark: SparkSession, d: str) -> DataFrame:
    rows = engine(spark, d).relation("orders").where("get_json_object(payload, '$.total')::double > 300000")
    out = dlq(rows, "sink", F.lit("rejected"), F.lit("too large"))
    return out.groupBy(F.col("headers").getItem("x-dlq-reason").alias("reason")).agg(F.count("*").alias("n"))


# -- continuous -----------------------------------------------------------------------------------------------------
def _running(spark: SparkSession, d: str, *names: str) -> Engine:
    """An engine whose log holds the named relations as streams s_..., each payload with the record's id."""
    e = engine(spark, d)
    for name in names:
        e.publish(f"s_{name}", e.relation(name).withColumn("payload", F.concat(F.expr("substring(payload, 1, length(payload) - 1)"), F.lit(',"id":'), "offset", F.lit("}"))), order=["timestamp", "key"])
    return e


def _run(e: Engine, text: str, **options) -> None:
    e.continuous.wait(e.continuous.create(text, **options))


@_op("SELECT event_id AS id, CAST(user_id AS VARCHAR) AS key FROM events WHERE event_type = 'click'")
def continuous_filter(spark: SparkSession, d: str) -> DataFrame:
    e = _running(spark, d, "events")
    _run(e, "CREATE VIEW c AS SELECT key, payload->>'id' AS id FROM s_events WHERE payload->>'type' = 'click' EMIT CHANGES")
    return e.sql("SELECT (payload->>'id')::BIGINT AS id, key FROM c")


@_op("SELECT epoch_us(w) AS w, type, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2) WHERE w + INTERVAL 1 HOUR + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events)")
def emit_final_stream(spark: SparkSession, d: str) -> DataFrame:
    e = _running(spark, d, "events")
    _run(e, "CREATE VIEW f AS SELECT TUMBLE(timestamp, INTERVAL '1 hour') AS w, payload->>'type' AS type, COUNT(*) AS n FROM s_events GROUP BY w, type EMIT FINAL")
    return e.sql("SELECT unix_micros((payload->>'w')::TIMESTAMP) AS w, payload->>'type' AS type, (payload->>'n')::BIGINT AS n FROM f")


@_op("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS w, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_view_stream(spark: SparkSession, d: str) -> DataFrame:
    e = _running(spark, d, "events")
    _run(e, "CREATE MATERIALIZED VIEW m AS SELECT TUMBLING(timestamp, '1 hour') AS w, payload->>'type' AS type, COUNT(*) AS n FROM s_events GROUP BY w, type")
    return e.sql("SELECT unix_micros(w) AS w, type, n FROM m")


@_op("SELECT event_type AS type, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY 1")
def materialized_view(spark: SparkSession, d: str) -> DataFrame:
    e = _running(spark, d, "events")
    _run(e, "CREATE MATERIALIZED VIEW m AS SELECT payload->>'type' AS type, COUNT(*) AS n, SUM((payload->>'value')::numeric) AS s FROM s_events GROUP BY 1")
    return e.sql("SELECT type, n, ROUND(s, 2) AS s FROM m")


@_op("SELECT event_type AS type, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def view_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    e.execute("CREATE MATERIALIZED VIEW counts AS SELECT payload->>'type' AS type, COUNT(*) AS n FROM events GROUP BY 1")
    return e.views.lookup("counts", "click")


@_op("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000")
def stream_stream_join(spark: SparkSession, d: str) -> DataFrame:
    e = _running(spark, d, "clicks", "purchases")
    _run(e, "CREATE VIEW j AS SELECT a.payload->>'id' AS a, b.payload->>'id' AS b FROM s_clicks a JOIN s_purchases b ON a.key = b.key WITHIN '10 minutes'")
    return e.sql("SELECT (payload->>'a')::BIGINT AS a, (payload->>'b')::BIGINT AS b FROM j")


@_op("SELECT event_id AS id, c_name AS name FROM events LEFT JOIN customer ON user_id = c_custkey")
def stream_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    e = _running(spark, d, "events")
    _run(e, "CREATE VIEW l AS SELECT s.payload->>'id' AS id, c.c_name AS name FROM s_events s LEFT JOIN warehouse.customer c ON s.key = c.c_custkey::text")
    return e.sql("SELECT (payload->>'id')::BIGINT AS id, payload->>'name' AS name FROM l")


@_op("SELECT event_id AS id, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS w, count(*) OVER p AS n, round(sum(value) OVER p, 2) AS s FROM events WINDOW p AS (PARTITION BY time_bucket(INTERVAL 1 DAY, ts), event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def stream_changelog_rows(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    e.publish("ev", e.relation("events").withColumn("o", F.col("offset")), order=["o"])
    lowest = _table(spark, d, "events").agg(F.min("event_id")).first()[0] or 0
    rows = e.log.read_stream("ev").withColumns({"type": F.get_json_object("payload", "$.type"), "value": F.get_json_object("payload", "$.value")})
    root = e.root
    q = stream_changelog(rows, "1 day", ["type"], "value").writeStream.format("parquet").option("path", f"{root}/cl").option("checkpointLocation", f"{root}/clc").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/cl").select((F.col("offset") + lowest).alias("id"), F.unix_micros("window_start").alias("w"), F.col("count").alias("n"), F.round("sum", 2).alias("s"))


def _halves(spark: SparkSession, d: str) -> tuple[Engine, DataFrame, DataFrame]:
    """An engine, and the events with their ids in the payload, in two parts by id."""
    e = engine(spark, d)
    rows = e.relation("events").withColumns({"o": F.col("offset"), "payload": F.concat(F.expr("substring(payload, 1, length(payload) - 1)"), F.lit(',"id":'), "offset", F.lit("}"))})
    n = rows.count() // 2
    lowest = rows.agg(F.min("o")).first()[0] or 0
    return e, rows.where(F.col("o") < lowest + n), rows.where(F.col("o") >= lowest + n)


@_op("SELECT event_id AS id FROM events")
def continuous_after_crash(spark: SparkSession, d: str) -> DataFrame:
    """A writer dies after it wrote a segment and before the commit: neither kind of reader may see it."""
    e, first, rest = _halves(spark, d)
    e.publish("s", first, order=["o"])
    first.select("offset", "timestamp", "subject", "key", "payload", "headers").write.parquet(f"{e.root}/streams/s/staged/died")
    q = e.continuous.create("CREATE VIEW c AS SELECT payload->>'id' AS id FROM s EMIT CHANGES")
    e.continuous.wait(q)
    e.publish("s", rest, order=["o"])
    e.continuous.wait(e.continuous.resume(q))
    e.continuous.wait(e.continuous.resume(q))
    return e.sql("SELECT (payload->>'id')::BIGINT AS id FROM c")


@_op("SELECT event_id AS id, CAST(user_id AS VARCHAR) AS key FROM events WHERE event_type = 'click'")
def projection_view_two_batches(spark: SparkSession, d: str) -> DataFrame:
    e, first, rest = _halves(spark, d)
    e.publish("s", first, order=["o"])
    q = e.continuous.create("CREATE MATERIALIZED VIEW m AS SELECT payload->>'id' AS id, key FROM s WHERE payload->>'type' = 'click'")
    e.continuous.wait(q)
    e.publish("s", rest, order=["o"])
    e.continuous.wait(e.continuous.resume(q))
    return e.sql("SELECT id::BIGINT AS id, key FROM m")


@_op("SELECT event_id AS id FROM events WHERE event_id < (SELECT min(event_id) + count(*) // 2 FROM events)")
def truncated_stream_continuous(spark: SparkSession, d: str) -> DataFrame:
    e, first, rest = _halves(spark, d)
    n = first.count()
    e.publish("s", first.unionByName(rest), order=["o"])
    e.log.truncate("s", n)
    _run(e, "CREATE VIEW c AS SELECT payload->>'id' AS id FROM s EMIT CHANGES")
    return e.sql("SELECT (payload->>'id')::BIGINT AS id FROM c")


@_op("SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def grouped_view_two_batches(spark: SparkSession, d: str) -> DataFrame:
    e, first, rest = _halves(spark, d)
    e.publish("s", first, order=["o"])
    q = e.continuous.create("CREATE MATERIALIZED VIEW m AS SELECT payload->>'type' AS type, COUNT(*) AS n FROM s GROUP BY 1")
    e.continuous.wait(q)
    e.publish("s", rest, order=["o"])
    e.continuous.wait(e.continuous.resume(q))
    return e.sql("SELECT type, n FROM m")


@_op("SELECT event_id AS id, CAST(user_id AS VARCHAR) AS key FROM events WHERE event_type = 'purchase' AND value > 50")
def index_sql(spark: SparkSession, d: str) -> DataFrame:
    """The index serves the first half by offsets; what came after it is scanned."""
    e, first, rest = _halves(spark, d)
    e.publish("s", first, order=["o"])
    e.execute("CREATE INDEX by_type ON s(payload->>'type')")
    e.publish("s", rest, order=["o"])
    return e.sql("SELECT (payload->>'id')::BIGINT AS id, key FROM s WHERE payload->>'type' = 'purchase' AND (payload->>'value')::numeric > 50")
