"""What all connectors share: transform, dedup, key field, retries, exhaustion, dead letters, configuration."""

from __future__ import annotations

import json
import os
import random
import re
import time
import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.errors import ParseError, PlanError, translated
from rivulet.functions.scalar import json_path, subject_matches
from rivulet.plans import dialect
from rivulet.sources.fs import Versions
from rivulet.sources.log import Log


class Outcome(Enum):
    """What a sink says of a batch."""

    SUCCESS = "success"
    POISON = "poison"
    TRANSIENT = "transient"


class Exhausted(Enum):
    """What to do with a batch whose retries are used up."""

    HALT = "halt"
    DLQ_BATCH = "dlq_batch"
    LOOP = "loop_forever"


@dataclass(frozen=True)
class Retry:
    """Exponential backoff with full jitter."""

    attempts: int = 5
    initial_ms: int = 100
    max_ms: int = 30_000
    factor: float = 2.0

    def limit_ms(self, attempt: int) -> float:
        return min(self.initial_ms * self.factor**attempt, self.max_ms)

    def delays(self, rng: random.Random | None = None) -> Iterator[float]:
        """Seconds to wait before each further attempt."""
        rng = rng or random.Random()
        for k in range(self.attempts - 1):
            yield rng.uniform(0, self.limit_ms(k)) / 1000


@dataclass
class ConnectorConfig:
    name: str
    kind: str  # source or sink
    plugin: str
    stream: str
    subject: str = ""
    settings: dict = field(default_factory=dict)
    transform_sql: str | None = None
    key_field: str | None = None
    dedup: bool = False
    dedup_header: str | None = None
    dedup_window_secs: int = 86_400
    retry: Retry = field(default_factory=Retry)
    exhausted: Exhausted = Exhausted.LOOP
    dlq_stream: str | None = None


_ENV = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")


def load_config(text: str, env: dict[str, str] | None = None) -> ConnectorConfig:
    """A TOML or JSON document; ${NAME} takes the environment's value, and an absent one is an error."""
    env = dict(os.environ) if env is None else env

    def value(m: re.Match) -> str:
        if m[1] not in env:
            raise ParseError(f"environment variable {m[1]} is not set")
        return env[m[1]].replace("\\", "\\\\").replace('"', '\\"')

    text = _ENV.sub(value, text)
    try:
        doc = json.loads(text) if text.lstrip().startswith("{") else tomllib.loads(text)
    except ValueError as e:
        raise ParseError(f"bad connector configuration: {e}") from e
    own, settings = doc.get("connector", {}), dict(doc.get("settings", {}))
    for need in ("name", "type", "plugin", "stream"):
        if need not in own:
            raise ParseError(f"connector.{need} is missing")
    if own["type"] not in ("source", "sink"):
        raise ParseError("connector.type must be source or sink")
    retry, dedup_ = doc.get("retry", {}), doc.get("dedup", {})
    return ConnectorConfig(
        own["name"], own["type"], own["plugin"], own["stream"], own.get("subject_filter", ""), settings, settings.pop("transform_sql", doc.get("transform_sql")), own.get("key_field"),
        bool(dedup_.get("enabled", bool(dedup_))), dedup_.get("header"), dedup_.get("window_secs", 86_400),
        Retry(retry.get("max_attempts", 5), retry.get("initial_ms", 100), retry.get("max_ms", 30_000), retry.get("multiplier", 2.0)), Exhausted(retry.get("on_exhausted", "loop_forever")), own.get("dlq_stream"),
    )


def transform(rows: DataFrame, sql: str) -> DataFrame:
    """SELECT ... [WHERE ...] without FROM over a record's columns: the payload becomes the projected object.

    A bare * lets records through as they are. Envelope columns stay.
    """
    items = dialect.tree(sql, dialect.tokens(sql))
    if any(dialect._is(x, "from", "group", "order", "limit", "having", "join") for x in items):
        raise PlanError("a transform is SELECT ... [WHERE ...] over one record")
    at = next((k for k, x in enumerate(items) if dialect._is(x, "where")), len(items))
    if not items or not dialect._is(items[0], "select"):
        raise PlanError("a transform begins with SELECT")
    r = dialect.Rewriter(sql, lambda name: "`" + name[0] + "`")
    with translated():
        kept = rows.where(r.expression(items[at + 1 :]).sql) if at < len(items) else rows
        columns = items[1:at]
        if len(columns) == 1 and dialect._is(columns[0], "*"):
            return kept
        named = [c for c in dialect._split(columns)]
        printed = [r._columns(c, frozenset()) for c in named]
        projected = kept.selectExpr("*", f"to_json(struct({', '.join(printed)})) AS __payload")
        return projected.withColumn("payload", F.col("__payload")).drop("__payload")


def dedup_key(header: str | None = None) -> Column:
    """The named header, else the record's key, else a hash of its content."""
    own = [F.try_element_at("headers", F.lit(header))] if header else []
    return F.coalesce(*own, F.col("key"), F.concat(F.lit("h:"), F.sha2(F.coalesce("payload", F.lit("")), 256)))


def dedup(rows: DataFrame, header: str | None = None, window_secs: int = 86_400) -> DataFrame:
    """One record of each dedup key: on a stream within the window, in batch the first one by time and offset."""
    keyed = rows.withColumn("__dk", dedup_key(header))
    if rows.isStreaming:
        return keyed.withWatermark("timestamp", f"{window_secs} seconds").dropDuplicatesWithinWatermark(["__dk"]).drop("__dk")
    order = F.struct("timestamp", "offset") if "offset" in rows.columns else F.col("timestamp")
    return keyed.groupBy("__dk").agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def fill_key(rows: DataFrame, field_name: str) -> DataFrame:
    return rows.withColumn("key", F.coalesce("key", F.get_json_object("payload", json_path(field_name))))


def dlq(rows: DataFrame, origin: str, reason: Column, detail: Column) -> DataFrame:
    """Records for a dead-letter stream: as they were, with headers on where and why they failed."""
    offset = F.col("offset").cast("string") if "offset" in rows.columns else F.lit("")
    own = {"x-dlq-origin": F.lit(origin), "x-dlq-reason": reason, "x-dlq-detail": detail, "x-dlq-original-offset": offset, "x-dlq-timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")}
    added = F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v.cast("string"))])
    return rows.withColumn("headers", F.map_concat(F.map_filter("headers", lambda k, v: ~k.isin(*own)), added)).select("timestamp", "subject", "key", "payload", "headers")


class SourceRunner:
    """Takes records from a source into its stream: dedup, transform, key field, append, then the source's cursor."""

    def __init__(self, log: Log, config: ConnectorConfig):
        from rivulet.sources.connectors.registry import SOURCES

        if config.plugin not in SOURCES:
            raise PlanError(f"no source plugin {config.plugin!r}", hint=", ".join(SOURCES))
        self.log, self.config, self.source = log, config, SOURCES[config.plugin](log.spark, config.settings)
        self._cursor = Versions(log.files, f"{log.root}/connectors/{config.name}")

    def poll(self) -> int:
        """One round; returns the number of records appended."""
        version, state = self._cursor.load()
        rows, cursor = self.source.poll((state or {}).get("cursor"))
        if rows is None:
            return 0
        c = self.config
        rows = dedup(rows, c.dedup_header, c.dedup_window_secs) if c.dedup else rows
        if c.dedup:
            self.log.create(c.stream)
            recent = self.log.read(c.stream).where(F.col("timestamp") >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(c.dedup_window_secs))))
            rows = rows.withColumn("__dk", dedup_key(c.dedup_header)).join(recent.select(dedup_key(c.dedup_header).alias("__dk")), "__dk", "left_anti").drop("__dk")
        rows = transform(rows, c.transform_sql) if c.transform_sql else rows
        rows = fill_key(rows, c.key_field) if c.key_field else rows
        first, after = self.log.append(c.stream, rows)
        self._cursor.save(version, {"cursor": cursor})
        return after - first


class SinkRunner:
    """Reads a stream from its cursor, filters and transforms, and hands batches to a sink, with retries."""

    def __init__(self, log: Log, config: ConnectorConfig, sleep: Callable[[float], None] = time.sleep):
        from rivulet.sources.connectors.registry import SINKS

        if config.plugin not in SINKS:
            raise PlanError(f"no sink plugin {config.plugin!r}", hint=", ".join(SINKS))
        self.log, self.config, self.sink, self._sleep = log, config, SINKS[config.plugin](log.spark, config.settings), sleep
        self._cursor = Versions(log.files, f"{log.root}/connectors/{config.name}")

    def run(self) -> int:
        """One round over all that is new; returns the number of records that were delivered."""
        version, state = self._cursor.load()
        c, (_, upto) = self.config, self.log.bounds(self.config.stream)
        start = (state or {}).get("offset", 0)
        if start >= upto:
            return 0
        rows = self.log.read(c.stream).where((F.col("offset") >= start) & (F.col("offset") < upto) & subject_matches("subject", c.subject))
        rows = transform(rows, c.transform_sql) if c.transform_sql else rows
        outcome, detail = Outcome.TRANSIENT, ""
        for wait in [0.0, *c.retry.delays()]:
            self._sleep(wait)
            good, bad, outcome, detail = self.sink.write(rows)
            if outcome is not Outcome.TRANSIENT:
                break
        if outcome is Outcome.TRANSIENT:
            if c.exhausted is not Exhausted.DLQ_BATCH:
                if c.exhausted is Exhausted.HALT:
                    raise PlanError(f"sink {c.name} gave up: {detail}")
                return 0  # the next round begins at the same offset
            self._dead(rows, F.lit("retries_exhausted"), F.lit(detail))
            good = 0
        elif bad is not None:
            why = {"reason", "error"} <= set(bad.columns)
            self._dead(bad, F.col("reason") if why else F.lit("poison"), F.col("error") if why else F.lit(detail))
        self._cursor.save(version, {"offset": upto})
        return good

    def _dead(self, rows: DataFrame, reason: Column, detail: Column) -> None:
        self.log.append(self.config.dlq_stream or f"{self.config.stream}-dlq", dlq(rows, self.config.name, reason, detail))

