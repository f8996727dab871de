"""Source and sink plugins by name.

A source gives `poll(cursor) -> (records or None, new cursor)`, a sink `write(records) -> (delivered, poison records
or None, outcome, detail)`. Sources whose wire a Spark job cannot speak by itself (logical replication, AMQP,
webhooks) read what a small listener lands as NDJSON; their mapping to records is here.
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.errors import ParseError, PlanError
from rivulet.functions.scalar import json_path
from rivulet.session import checkpoint_dir
from rivulet.sources.connectors import schema, sql
from rivulet.sources.connectors.files import write_ndjson
from rivulet.sources.connectors.pipeline import Outcome
from rivulet.sources.log import MESSAGE_ID

_SLOT = re.compile(r"\{\$?\.?([A-Za-z0-9_.]+)\}")


def template(text: str, payload: str = "payload") -> Column:
    """'{$.a.b}' and '{a}' in `text` replaced by fields of the payload; what is missing is 'unknown'."""
    parts, at = [], 0
    for m in _SLOT.finditer(text):
        parts += [F.lit(text[at : m.start()]), F.coalesce(F.get_json_object(F.col(payload), json_path(*m[1].split("."))), F.lit("unknown"))]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def _headers(pairs: dict[str, Column]) -> Column:
    if not pairs:
        return F.expr("cast(map() as map<string,string>)")
    return F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())


class Landing:
    """Files that a listener lands in a folder, one JSON object a line; the cursor is the set of files by name order."""

    def __init__(self, spark: SparkSession, settings: dict):
        self.spark, self.settings = spark, settings
        if "path" not in settings:
            raise PlanError("settings.path is missing")

    def poll(self, cursor: str | None) -> tuple[DataFrame | None, str | None]:
        rows = self.spark.read.text(self.settings["path"]).withColumn("__f", F.input_file_name())
        new = rows if cursor is None else rows.where(F.col("__f") > cursor)
        last = new.agg(F.max("__f")).first()[0]
        if last is None:
            return None, cursor
        return self.records(new.where(F.col("__f") <= last).select(F.col("value").alias("payload")).where(F.length(F.trim("payload")) > 0)), last

    def records(self, rows: DataFrame) -> DataFrame:
        subject = template(self.settings.get("subject", self.settings.get("subject_template", "webhook")))
        key = F.get_json_object("payload", json_path(*self.settings["key_path"].removeprefix("$.").split("."))) if "key_path" in self.settings else F.lit(None).cast("string")
        return rows.select(F.current_timestamp().alias("timestamp"), subject.alias("subject"), key.alias("key"), "payload", _headers({}).alias("headers"))


class Changes(Landing):
    """Row changes {schema, table, op, lsn, pk, row} of a database's log: subject schema.table.op, key the first column."""

    def records(self, rows: DataFrame) -> DataFrame:
        f = lambda *k: F.get_json_object("payload", json_path(*k))
        row = f("row")
        first = F.element_at(F.map_values(F.from_json(row, "map<string,string>")), 1)
        key = F.coalesce(f("pk"), first)
        once = F.concat_ws(":", f("table"), key, f("lsn"))
        return rows.select(F.current_timestamp().alias("timestamp"), F.concat_ws(".", f("schema"), f("table"), f("op")).alias("subject"), key.alias("key"), row.alias("payload"), _headers({MESSAGE_ID: once}).alias("headers"))


class Queue(Landing):
    """Messages {routing_key, body, content_type, correlation_id, message_id} of a broker."""

    def records(self, rows: DataFrame) -> DataFrame:
        f = lambda k: F.get_json_object("payload", json_path(k))
        heads = _headers({"content-type": f("content_type"), "correlation-id": f("correlation_id"), MESSAGE_ID: f("message_id")})
        return rows.select(F.current_timestamp().alias("timestamp"), f("routing_key").alias("subject"), f("routing_key").alias("key"), f("body").alias("payload"), heads.alias("headers"))


class Table:
    """New rows of a table by a growing column. `url` is JDBC, or a Parquet table's path, which tests and data lakes use."""

    def __init__(self, spark: SparkSession, settings: dict):
        self.spark, self.settings = spark, settings
        self.tracking = settings.get("tracking_column", "id")
        self.limit = int(settings.get("batch_size", 1000))

    def rows(self, cursor: int | None) -> DataFrame:
        s = self.settings
        if not s["url"].startswith("jdbc:"):
            return self.spark.read.parquet(s["url"])
        d = sql.Dialect(s.get("database", "postgres"))
        where = f"SELECT * FROM {d.table(s['table'])}" + (f" WHERE {d.quote(self.tracking)} > {int(cursor)}" if cursor is not None else "")
        return self.spark.read.format("jdbc").option("url", s["url"]).option("query", where).load()

    def poll(self, cursor: int | None) -> tuple[DataFrame | None, int | None]:
        rows = self.rows(cursor)
        new = rows if cursor is None else rows.where(F.col(self.tracking) > cursor)
        # The batch ends at a value, not at a row, so that rows with equal values stay together.
        upto = new.select(self.tracking).orderBy(self.tracking).limit(self.limit).agg(F.max(self.tracking)).first()[0]
        if upto is None:
            return None, cursor
        return self.records(new.where(F.col(self.tracking) <= upto)), int(upto)

    def records(self, rows: DataFrame) -> DataFrame:
        names = self.settings.get("columns") or rows.columns
        payload = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
        key = F.col(self.settings.get("key_column", self.tracking)).cast("string")
        once = F.concat_ws(":", F.lit(self.settings.get("table", "table")), F.col(self.tracking).cast("string"))
        made = rows.select(payload.alias("payload"), key.alias("key"), once.alias("once"))
        subject = template(self.settings.get("subject", self.settings.get("table", "table")))
        return made.select(F.current_timestamp().alias("timestamp"), subject.alias("subject"), "key", "payload", _headers({MESSAGE_ID: F.col("once")}).alias("headers"))


class Outbox(Table):
    """An outbox table (id, aggregate_type, aggregate_id, event_type, payload)."""

    def records(self, rows: DataFrame) -> DataFrame:
        subject = F.concat_ws(".", "aggregate_type", "event_type")
        return rows.select(F.current_timestamp().alias("timestamp"), subject.alias("subject"), F.col("aggregate_id").cast("string").alias("key"), F.col("payload").cast("string").alias("payload"), _headers({MESSAGE_ID: F.col(self.tracking)}).alias("headers"))


class CaptureTable(Table):
    """SQL Server's change tables, by log position; __op names the operation."""

    def __init__(self, spark: SparkSession, settings: dict):
        super().__init__(spark, {"tracking_column": "__$start_lsn"} | settings)

    def poll(self, cursor: str | None) -> tuple[DataFrame | None, str | None]:
        """Positions are binary(10); the cursor is their hexadecimal text, which has the same order."""
        s, at = self.settings, F.hex(F.col(f"`{self.tracking}`"))
        if s["url"].startswith("jdbc:"):
            d = sql.Dialect(s.get("database", "mssql"))
            after = f" WHERE {d.quote(self.tracking)} > 0x{int(cursor, 16):020X}" if cursor is not None else ""
            rows = self.spark.read.format("jdbc").option("url", s["url"]).option("query", f"SELECT * FROM {d.table(s['table'])}{after}").load()
        else:
            rows = self.spark.read.parquet(s["url"])
        new = rows if cursor is None else rows.where(at > cursor)
        upto = new.select(at.alias("at")).orderBy("at").limit(self.limit).agg(F.max("at")).first()[0]
        return (None, cursor) if upto is None else (self.records(new.where(at <= upto)), upto)

    def records(self, rows: DataFrame) -> DataFrame:
        names = F.create_map(*[x for k, v in sql.CDC_OPERATIONS.items() for x in (F.lit(k), F.lit(v))])
        own = [c for c in rows.columns if not c.startswith("__$")]
        shown = rows.select(*own, F.try_element_at(names, F.col("`__$operation`").cast("int")).alias("__op"), F.col(f"`{self.tracking}`").alias("lsn"))
        payload = F.to_json(F.struct(*own, "__op"), {"ignoreNullFields": "false"})
        return shown.select(F.current_timestamp().alias("timestamp"), F.concat_ws(".", F.lit(self.settings.get("table", "table")), "__op").alias("subject"), F.col(own[0]).cast("string").alias("key"), payload.alias("payload"), _headers({MESSAGE_ID: F.concat_ws(":", F.col(own[0]).cast("string"), F.hex("lsn"), "__op")}).alias("headers"))


def _http(url: str, body: bytes | None, headers: dict[str, str], method: str, timeout: float) -> tuple[int, dict[str, str], bytes]:
    request = urllib.request.Request(url, data=body, headers=headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


def items_at(doc, path: str) -> list:
    """The items of an answer: '$' is the document, '$.a.b' what stands there; a single value is a list of one."""
    for key in path.removeprefix("$").strip(".").split("."):
        if key:
            if not isinstance(doc, dict) or key not in doc:
                raise ParseError(f"the answer has nothing at {path}")
            doc = doc[key]
    return doc if isinstance(doc, list) else [doc]


class HttpPoll:
    """GET with ETag and Last-Modified; each item of the answer is a record."""

    def __init__(self, spark: SparkSession, settings: dict, call: Callable = _http):
        self.spark, self.settings, self.call = spark, settings, call

    def poll(self, cursor: dict | None) -> tuple[DataFrame | None, dict | None]:
        s, cursor = self.settings, cursor or {}
        headers = dict(s.get("headers", {})) | {h: cursor[c] for c, h in (("etag", "If-None-Match"), ("modified", "If-Modified-Since")) if cursor.get(c)}
        status, answer, body = self.call(s["url"], None, headers, "GET", float(s.get("timeout_secs", 30)))
        if status == 304:
            return None, cursor
        if status != 200:
            raise PlanError(f"{s['url']} answered {status}")
        low = {k.lower(): v for k, v in answer.items()}
        items = items_at(json.loads(body), s.get("items_path", "$"))
        rows = self.spark.createDataFrame([(json.dumps(x),) for x in items], "payload string")
        return Landing(self.spark, {"path": ""} | s).records(rows), {"etag": low.get("etag"), "modified": low.get("last-modified")}


class NdjsonSink:
    def __init__(self, spark: SparkSession, settings: dict):
        self.settings = settings

    def write(self, rows: DataFrame):
        write_ndjson(rows, self.settings["path"], int(self.settings.get("flush_records", 1000)))
        return rows.count(), None, Outcome.SUCCESS, ""


class HttpSink:
    """One request a record, from the executors. A 4xx answer is poison, any other failure transient."""

    def __init__(self, spark: SparkSession, settings: dict, call: Callable = _http):
        self.settings, self.call = settings, call

    def write(self, rows: DataFrame):
        s, call = self.settings, self.call

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                codes = []
                for p in batch["payload"]:
                    try:
                        codes.append(call(s["url"], (p or "").encode(), {"Content-Type": "application/json"} | dict(s.get("headers", {})), s.get("method", "POST"), float(s.get("timeout_secs", 30)))[0])
                    except OSError:
                        codes.append(0)
                yield batch[["offset"]].assign(code=codes)

        sent = rows.select("offset", "payload").mapInPandas(send, "offset long, code int").persist()
        try:
            found = sent.agg(F.count_if((F.col("code") >= 200) & (F.col("code") < 300)), F.count_if((F.col("code") >= 400) & (F.col("code") < 500)), F.count("*")).first()
            good, poison, total = found
            if good + poison < total:
                return good, None, Outcome.TRANSIENT, f"{total - good - poison} requests failed"
            if not poison:
                return good, None, Outcome.SUCCESS, ""
            checkpoint_dir(rows.sparkSession)
            # Requests are not repeated to find out again: the refused offsets are kept on disk.
            refused = sent.where((F.col("code") >= 400) & (F.col("code") < 500)).checkpoint()
            bad = rows.join(refused.select(F.col("offset").alias("__o"), "code"), F.col("offset") == F.col("__o")).drop("__o")
            bad = bad.withColumns({"reason": F.lit("poison"), "error": F.concat(F.lit("status "), F.col("code").cast("string"))}).drop("code")
            return good, bad, Outcome.POISON, "refused"
        finally:
            sent.unpersist()


class JdbcSink:
    """Rows to a table: typed by a schema, else as blobs. Records that do not fit the schema are poison.

    With `execute`, which runs SQL at the database, rows go to a side table first, and one statement moves them: in the
    mode upsert (the default where `key` columns are set) rows with a known key replace the old ones, in the mode insert
    they are passed over; of rows of one batch with one key the last by offset counts. So a batch that is sent again
    changes nothing. Without `execute` rows are inserted by Spark's writer; a batch that the database refuses for a
    known key goes to the dead letters, as nobody can tell which of its rows are there.
    """

    def __init__(self, spark: SparkSession, settings: dict, execute: Callable[[str], None] | None = None, save: Callable[[DataFrame, str], None] | None = None):
        self.settings, self.execute = settings, execute
        self.dialect = sql.Dialect(settings.get("database", "postgres"))
        self.fields = schema.parse(settings["schema"]) if "schema" in settings else sql.BLOB
        self.key = [k for k in (settings.get("key") or "").split(",") if k] or ([] if "schema" in settings else ["offset"])
        self.save = save or (lambda rows, table: rows.write.mode("append").jdbc(settings["url"], table, properties=settings.get("properties", {})))

    def _staged(self, out: DataFrame) -> None:
        d, table = self.dialect, self.settings["table"]
        stage = f"{table}_stage_{uuid.uuid4().hex[:8]}"
        self.execute(d.create(table, self.fields, self.key))
        self.execute(d.create(stage, self.fields, []))
        try:
            self.save(out, stage)
            self.execute(d.move(table, stage, self.fields, self.key, replace=self.settings.get("mode", "upsert") == "upsert"))
        finally:
            self.execute(f"DROP TABLE {d.table(stage)}")

    def write(self, rows: DataFrame):
        if "schema" in self.settings:
            bound = schema.bind(rows, self.fields)
            good, bad = bound.where(F.col("error").isNull()), bound.where(F.col("error").isNotNull()).withColumn("reason", F.lit("schema"))
        else:
            bad, good = None, rows.withColumn("value", F.col("payload"))
        names = [f.name for f in self.fields]
        out = good.select(*names)
        total = out.count()
        try:
            if self.execute and self.key:
                # A name of a key column may be "offset" itself, so the record's place has a name of its own.
                last = good.select(*names, F.col("offset").alias("__at")).groupBy(*self.key).agg(F.max_by(F.struct(*names), "__at").alias("r"))
                self._staged(last.select("r.*"))
            else:
                self.save(out, self.settings["table"])
        except Exception as e:  # a driver's own exception; its state says what it is
            state = re.search(r"SQLSTATE[:( ]+(\w{5})", str(e))
            kind = sql.classify(state[1] if state else None)
            if kind == "transient":
                return 0, None, Outcome.TRANSIENT, str(e).split("\n")[0]
            dead = rows.withColumns({"reason": F.lit(kind), "error": F.lit(str(e).split("\n")[0])})
            return 0, dead, Outcome.POISON, str(e).split("\n")[0]
        poison = bad is not None and bad.limit(1).count() > 0
        return total, bad if poison else None, Outcome.POISON if poison else Outcome.SUCCESS, ""


class QueueSink:
    """Hands each partition's records to a publisher, with the routing key from subject, key or a literal."""

    def __init__(self, spark: SparkSession, settings: dict, publish: Callable[[list[tuple[str, str]]], None] | None = None):
        self.settings, self.publish = settings, publish

    def routing(self) -> Column:
        where = self.settings.get("routing_key", "subject")
        return F.coalesce(F.col(where), F.lit("")) if where in ("subject", "key") else F.lit(where)

    def write(self, rows: DataFrame):
        publish = self.publish
        if publish is None:
            raise PlanError("no publisher is given", hint="QueueSink(spark, settings, publish=...)")

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                publish(list(zip(batch["route"], batch["payload"], strict=True)))
                yield pd.DataFrame({"n": [len(batch)]})

        n = rows.select(self.routing().alias("route"), "payload").mapInPandas(send, "n long").agg(F.sum("n")).first()[0]
        return n or 0, None, Outcome.SUCCESS, ""


SOURCES: dict[str, Callable] = {
    "http_webhook": Landing, "http_poll": HttpPoll, "postgres_outbox": Outbox, "postgres": Changes, "postgres_cdc": Changes, "jdbc_poll": Table, "mssql_cdc": CaptureTable, "rabbitmq": Queue,
}
SINKS: dict[str, Callable] = {"http_sink": HttpSink, "jdbc": JdbcSink, "rabbitmq": QueueSink, "s3": NdjsonSink, "ndjson": NdjsonSink}
