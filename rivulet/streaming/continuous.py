"""Continuous queries: a query over unbounded streams whose rows go to a stream or a materialized view.

The shape of the plan decides the output mode: without aggregates rows are appended; with EMIT CHANGES an aggregate
emits what changed in each batch; with EMIT FINAL a window is emitted once, when it is closed by the watermark.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rivulet.errors import PlanError, StorageError, Unsupported
from rivulet.plans import dialect
from rivulet.sources.envelope import from_rows
from rivulet.sources.fs import Versions

GRACE = "5 minutes"
_CREATE = re.compile(r"^\s*create\b", re.I)


class Continuous:
    """Creates, lists, stops and resumes the continuous queries of an engine."""

    def __init__(self, engine):
        self.engine = engine
        self._live: dict[str, StreamingQuery] = {}
        self._grace = GRACE
        self._snapshot: set[str] = set()

    def _registry(self) -> Versions:
        return Versions(self.engine.log.files, f"{self.engine.root}/queries")

    def source(self, name: str) -> DataFrame:
        """A relation inside a continuous query: streams are unbounded with a watermark, all else is as it is now."""
        log = self.engine.log
        if name.lower() not in self.engine._relations and not self.engine.views.exists(name) and log.exists(name) and name not in self._snapshot:
            return log.read_stream(name).withWatermark("timestamp", self._grace)
        return self.engine.relation(name)

    def frame(self, text: str, grace: str = GRACE, snapshot: tuple[str, ...] = ()) -> tuple[dialect.Statement, DataFrame]:
        """The unbounded plan of a query. Streams named in `snapshot` are read once, as tables to look up in."""
        self._grace, self._snapshot = grace, set(snapshot)
        try:
            statement, frame = self.engine.plan(text, streaming=True)
        finally:
            self._grace, self._snapshot = GRACE, set()
        if frame is None or statement.kind not in ("select", "view", "materialized"):
            raise PlanError("a query is expected")
        if not frame.isStreaming:
            raise PlanError("a continuous query needs a stream in FROM")
        if any(t.low in ("order", "limit") for t in dialect.tokens(text)):
            raise Unsupported("ORDER BY and LIMIT have no meaning over an unbounded stream", hint="query the result with them")
        return statement, frame

    @staticmethod
    def aggregates(frame: DataFrame) -> bool:
        return "Aggregate [" in frame._jdf.queryExecution().analyzed().toString()

    def create(self, text: str, name: str | None = None, start: bool = True, **options) -> str:
        """CREATE VIEW v AS SELECT ... [EMIT CHANGES | EMIT FINAL] or a bare SELECT; returns the query's id."""
        text = text if _CREATE.match(text) else f"CREATE VIEW {name or 'out_' + uuid.uuid4().hex[:8]} AS {text}"
        statement, frame = self.frame(text, **{k: v for k, v in options.items() if k in ("grace", "snapshot")})
        target = statement.name
        version, known = self._registry().load()
        known = known or {}
        if any(q["target"] == target and q["status"] == "running" for q in known.values()):
            raise StorageError(f"{target!r} is already the target of a query")
        query = f"q_{time.time_ns() // 1000:x}"
        if statement.kind == "view":
            self.engine.log.create(target)
        self._registry().save(version, known | {query: {"sql": text, "target": target, "status": "running" if start else "stopped", "options": {k: list(v) if isinstance(v, tuple) else v for k, v in options.items()}}})
        if start:
            self._start(query, statement, frame, **options)
        return query

    def _start(self, query: str, statement: dialect.Statement, frame: DataFrame, trigger: dict | None = None, keys: list[str] | None = None, **_) -> StreamingQuery:
        log, views, target = self.engine.log, self.engine.views, statement.name
        grouped = self.aggregates(frame)
        mode = ("append" if statement.emit == "final" else "update") if grouped else "append"

        def write(batch: DataFrame, number: int) -> None:
            rows = batch.persist()
            try:
                if statement.kind == "materialized":
                    by = (keys if keys is not None else self.keys(statement, batch)) if grouped else None
                    views.merge(target, rows, by, (query, number))
                else:
                    # The number is committed with the records: a batch that was written before a crash is not written again.
                    log.append(target, from_rows(rows, target), mark=(query, number))
            finally:
                rows.unpersist()

        writer = frame.writeStream.outputMode(mode).queryName(query).option("checkpointLocation", f"{self.engine.root}/queries/{query}/checkpoint").foreachBatch(write)
        self._live[query] = writer.trigger(**(trigger or {"availableNow": True})).start()
        return self._live[query]

    @staticmethod
    def keys(statement: dialect.Statement, batch: DataFrame) -> list[str]:
        """The output columns that are group keys: those that hold no aggregate."""
        r = dialect.tree(statement.text, dialect.tokens(statement.text))
        at = next(k for k, x in enumerate(r) if dialect._is(x, "select"))
        end = next((k for k, x in enumerate(r) if k > at and dialect._is(x, "from")), len(r))
        out = []
        for column, part in zip(batch.columns, dialect._split(r[at + 1 : end]), strict=True):
            calls = [x.low for x, y in zip(part, part[1:], strict=False) if isinstance(x, dialect.Token) and isinstance(y, dialect.Group)]
            if not any(c in ("count", "sum", "avg", "min", "max") for c in calls):
                out.append(column)
        return out

    def wait(self, query: str, timeout: float | None = None) -> bool:
        live = self._live.get(query)
        return True if live is None else bool(live.awaitTermination(timeout) if timeout else live.awaitTermination() is None)

    def list(self) -> dict[str, dict]:
        out = dict(self._registry().load()[1] or {})
        for q, live in self._live.items():
            if q in out and live.exception() is not None:
                out[q] = out[q] | {"status": "failed", "error": str(live.exception()).split("\n")[0]}
        return out

    def stop(self, query: str) -> None:
        if live := self._live.pop(query, None):
            live.stop()
        self._mark(query, "stopped")

    def remove(self, query: str) -> None:
        self.stop(query)
        version, known = self._registry().load()
        self._registry().save(version, {k: v for k, v in known.items() if k != query})
        self.engine.log.files.delete(f"{self.engine.root}/queries/{query}")

    def _mark(self, query: str, status: str) -> None:
        version, known = self._registry().load()
        if query not in (known or {}):
            raise StorageError(f"no query {query!r}")
        self._registry().save(version, known | {query: known[query] | {"status": status}})

    def resume(self, query: str, **options) -> str:
        """Go on from the checkpoint, with all state that was kept."""
        known = (self._registry().load()[1] or {}).get(query)
        if known is None:
            raise StorageError(f"no query {query!r}")
        options = {k: tuple(v) if k == "snapshot" else v for k, v in known["options"].items()} | options
        statement, frame = self.frame(known["sql"], **{k: v for k, v in options.items() if k in ("grace", "snapshot")})
        if query in self._live and self._live[query].isActive:
            self._live[query].stop()
        self._start(query, statement, frame, **options)
        self._mark(query, "running")
        return query

    def resume_all(self) -> list[str]:
        return [self.resume(q) for q, v in (self._registry().load()[1] or {}).items() if v["status"] == "running"]


def stream_changelog(frame: DataFrame, size: str, by: list[str], value: str | None = None, grace: str = GRACE) -> DataFrame:
    """On an unbounded stream, one row for each record: the running count (and sum, min, max, avg of `value`) of its
    tumbling window and keys. Records of a batch are taken in order of offset; state goes when the window is closed."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    from rivulet.functions.interval import micros

    us = micros(size)
    lateness = micros(grace)
    start = F.unix_micros("timestamp") - F.pmod(F.unix_micros("timestamp"), F.lit(us))
    rows = frame.withWatermark("timestamp", grace).withColumn("__w", F.timestamp_micros(start))
    rows = rows.select("offset", "timestamp", "__w", *by, (F.col(value).try_cast("double") if value else F.lit(None).cast("double")).alias("__v"))
    types = dict(rows.dtypes)
    schema = "offset long, window_start timestamp, " + "".join(f"`{c}` {types[c]}, " for c in by) + "count long, sum double, min double, max double, avg double"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, k, total, low, high = state.get if state.exists else (0, 0, 0.0, None, None)
        batch = pd.concat(list(frames)).sort_values("offset")
        out = []
        for offset, v in zip(batch["offset"], batch["__v"], strict=True):
            n += 1
            if not pd.isna(v):
                k, total, low, high = k + 1, total + v, v if low is None else min(low, v), v if high is None else max(high, v)
            out.append((offset, key[0], *key[1:], n, total if k else None, low, high, total / k if k else None))
        state.update((n, k, total, low, high))
        end = int(pd.Timestamp(key[0]).timestamp() * 1000) + us // 1000 + lateness // 1000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["offset", "window_start", *by, "count", "sum", "min", "max", "avg"])

    grouped = rows.groupBy("__w", *by)
    return grouped.applyInPandasWithState(step, schema, "n long, k long, total double, low double, high double", "append", GroupStateTimeout.EventTimeTimeout)
