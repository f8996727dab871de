"""The engine: bounded queries, continuous queries, materialized views, indexes and connections over one log."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.errors import PlanError, StorageError, StreamError, Unsupported, translated
from rivulet.plans import dialect
from rivulet.sources.fs import Versions
from rivulet.sources.log import Log, StreamConfig, valid_name
from rivulet.streaming.continuous import Continuous
from rivulet.streaming.views import Views

#: Hits of an index that are sought by offset; more are joined.
SOUGHT = 1000
#: Rows that an API answer holds where the query sets no limit of its own.
RESULT_CAP = 10_000
_DRIVERS = {"postgres": "org.postgresql.Driver", "postgresql": "org.postgresql.Driver", "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "mysql": "com.mysql.cj.jdbc.Driver", "sqlite": "org.sqlite.JDBC"}


class Engine:
    """Queries see each stream, view and registered table as a relation.

    `root` is a folder on a file system that driver and executors share.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, self.root)
        self.views = Views(spark, self.log)
        self.continuous = Continuous(self)
        self._relations: dict[str, Callable[[], DataFrame]] = {}
        self._connections = Versions(self.log.files, f"{self.root}/connections")
        self._indexes = Versions(self.log.files, f"{self.root}/indexes")

    # -- relations ----------------------------------------------------------------------------------------------
    def register(self, name: str, frame: DataFrame | Callable[[], DataFrame]) -> None:
        """Make a DataFrame (or what returns one) a relation, for instance an external table or a stream held elsewhere."""
        self._relations[name.lower()] = frame if callable(frame) else (lambda: frame)

    def relation(self, name: str) -> DataFrame:
        low = name.lower()
        if low in self._relations:
            return self._relations[low]()
        if self.views.exists(name):
            return self.views.read(name)
        if self.log.exists(name):
            return self.log.read(name)
        raise PlanError(f"no stream or view {name!r}")

    def connect(self, name: str, driver: str, url: str, **options: str) -> None:
        """Register an external database. `driver` parquet takes a folder of Parquet tables in `url`."""
        if driver not in _DRIVERS and driver != "parquet":
            raise Unsupported(f"driver {driver!r}", hint=", ".join([*_DRIVERS, "parquet"]))
        version, known = self._connections.load()
        self._connections.save(version, (known or {}) | {valid_name(name): {"driver": driver, "url": url, "options": options}})

    def disconnect(self, name: str) -> None:
        version, known = self._connections.load()
        self._connections.save(version, {k: v for k, v in (known or {}).items() if k != name})

    def connections(self) -> dict[str, dict]:
        return {k: {"driver": v["driver"]} for k, v in (self._connections.load()[1] or {}).items()}

    def external(self, connection: str, table: str) -> DataFrame:
        known = (self._connections.load()[1] or {}).get(connection)
        if known is None:
            raise PlanError(f"no connection {connection!r}")
        return self._external(known["driver"], known["url"], table, known["options"])

    def _external(self, driver: str, url: str, table: str, options: dict) -> DataFrame:
        if driver == "parquet":
            return self.spark.read.parquet(f"{url.rstrip('/')}/{table}.parquet")
        return self.spark.read.format("jdbc").option("driver", _DRIVERS[driver]).options(**options).option("url", url if url.startswith("jdbc:") else f"jdbc:{url}").option("dbtable", table).load()

    def _narrowed(self, sql: str) -> dict[str, DataFrame]:
        """The stream of a query whose WHERE an index can serve, cut down to the index's hits: {name: records}."""
        known = self._indexes.load()[1]
        asked = dialect.field_equals(sql) if known else None
        if asked is None or asked[0].lower() in self._relations or self.views.exists(asked[0]):
            return {}
        for one in known.values():
            value = asked[1].get(tuple(one["path"]))
            if one["stream"] == asked[0] and value is not None:
                return {asked[0]: self._hits(one, value)}
        return {}

    def _table(self, temp: dict[str, DataFrame], stream: bool = False, narrowed: dict[str, DataFrame] | None = None) -> Callable[[tuple[str, ...]], str]:
        """Gives each relation of a query a temporary view of its own and returns the view's name."""

        def find(name: tuple[str, ...]) -> str:
            if name[0] == "external" and len(name) == 3:
                frame = self.external(name[1], name[2])
            elif name[0] in ("postgres", "mssql") and len(name) == 3:
                frame = self._external(name[0], name[1], name[2], {})
            elif len(name) == 2:
                held = self._relations.get(".".join(name).lower())
                frame = held() if held else self.external(*name)
            elif len(name) == 1:
                frame = self.continuous.source(name[0]) if stream else (narrowed or {}).get(name[0]) or self.relation(name[0])
            else:
                raise PlanError(f"no relation {'.'.join(name)!r}")
            view = f"rivulet_{uuid.uuid4().hex}"
            frame.createOrReplaceTempView(view)
            temp[view] = frame
            return f"`{view}`"

        return find

    def plan(self, sql: str, streaming: bool = False, table: Callable | None = None) -> tuple[dialect.Statement, DataFrame | None]:
        """The statement and, for those with a query, its DataFrame."""
        temp: dict[str, DataFrame] = {}
        try:
            narrowed = {} if streaming or table else self._narrowed(sql)
            statement = dialect.parse(sql, table or self._table(temp, streaming, narrowed), streaming)
            frame = None
            if statement.sql:
                with translated():
                    frame = self.spark.sql(statement.sql)
            return statement, frame
        finally:
            for view in temp:
                self.spark.catalog.dropTempView(view)

    # -- bounded queries ----------------------------------------------------------------------------------------
    def sql(self, text: str) -> DataFrame:
        """A bounded query as a DataFrame; nothing runs yet."""
        statement, frame = self.plan(text)
        if statement.kind != "select":
            raise Unsupported(f"{statement.kind} is not a bounded query", hint="use execute()")
        return frame

    def query(self, text: str) -> dict:
        """A bounded query's answer: columns, rows, row_count, execution_time_ms. Without a LIMIT of its own at most
        RESULT_CAP rows are brought to the caller."""
        began = time.time()
        frame = self.sql(text)
        limited = any(t.low == "limit" for t in dialect.tokens(text))
        with translated():
            rows = (frame if limited else frame.limit(RESULT_CAP)).collect()
        return {"columns": frame.columns, "rows": [list(r) for r in rows], "row_count": len(rows), "execution_time_ms": round(1000 * (time.time() - began))}

    def execute(self, text: str):
        """Any statement: a DataFrame for SELECT, the query's or view's id or name for CREATE, None for DROP."""
        statement = dialect.parse(text, lambda name: "`x`")
        if statement.kind == "select":
            return self.sql(text)
        if statement.kind == "view":
            return self.continuous.create(text)
        if statement.kind == "materialized":
            return self.create_view(text)
        if statement.kind == "create_index":
            return self.create_index(statement.name, statement.stream, *statement.path)
        if statement.kind == "drop_index":
            return self.drop_index(statement.name)
        for name, one in (self._indexes.load()[1] or {}).items():
            if one["stream"] == statement.name:
                self.drop_index(name)
        return self.log.delete(statement.name)

    # -- streams ------------------------------------------------------------------------------------------------
    def create_stream(self, name: str, config: StreamConfig | None = None) -> None:
        self.log.create(name, config)

    def publish(self, stream: str, records: DataFrame, **options) -> tuple[int, int]:
        return self.log.append(stream, records, **options)

    # -- materialized views -------------------------------------------------------------------------------------
    def create_view(self, text: str) -> str:
        """CREATE MATERIALIZED VIEW: computed now, and again by refresh_view; kept on disk."""
        statement = dialect.parse(text, lambda name: "`x`")
        if statement.kind != "materialized":
            raise PlanError("CREATE MATERIALIZED VIEW is expected")
        _, frame = self.plan(text)
        self.views.write(statement.name, frame, text)
        return statement.name

    def refresh_view(self, name: str) -> None:
        text = self.views.text(name)
        _, frame = self.plan(text)
        self.views.write(name, frame, text)

    # -- indexes ------------------------------------------------------------------------------------------------
    def create_index(self, name: str, stream: str, *path: str) -> str:
        """An index over a JSON field: rows (value, offset), range-partitioned by value so that a lookup reads few files."""
        version, known = self._indexes.load()
        if name in (known or {}):
            raise StorageError(f"index {name!r} exists")
        at = f"{self.root}/index/{valid_name(name)}-{uuid.uuid4().hex[:8]}"
        upto = self.log.bounds(stream)[1]
        self._index_rows(stream, path, 0, upto).write.parquet(at)
        self._indexes.save(version, (known or {}) | {name: {"stream": stream, "path": list(path), "at": at, "upto": upto, "cuts": len(self.log.cuts(stream))}})
        return name

    def _upto(self, one: dict) -> int:
        """Where an index ends: records that came after a truncation are not in it."""
        return min([one["upto"], *self.log.cuts(one["stream"])[one["cuts"] :]])

    def _index_rows(self, stream: str, path: tuple[str, ...], first: int, upto: int) -> DataFrame:
        value = F.get_json_object("payload", dialect.json_path(*path))
        rows = self.log.read(stream).where((F.col("offset") >= first) & (F.col("offset") < upto)).select(value.alias("value"), "offset")
        return rows.where(F.col("value").isNotNull()).repartitionByRange("value", "offset").sortWithinPartitions("value", "offset")

    def refresh_index(self, name: str) -> None:
        """Add what was appended since."""
        version, known = self._indexes.load()
        one = known[name]
        upto = self.log.bounds(one["stream"])[1]
        self._index_rows(one["stream"], tuple(one["path"]), self._upto(one), upto).write.mode("append").parquet(one["at"])
        self._indexes.save(version, known | {name: one | {"upto": upto, "cuts": len(self.log.cuts(one["stream"]))}})

    def drop_index(self, name: str) -> None:
        version, known = self._indexes.load()
        one = (known or {}).get(name)
        if one is None:
            raise StorageError(f"no index {name!r}")
        self._indexes.save(version, {k: v for k, v in known.items() if k != name})
        self.log.files.delete(one["at"])

    def index_lookup(self, name: str, value: str) -> DataFrame:
        """Records whose indexed field has `value`: by the index up to where it goes, by a scan for what came later."""
        one = (self._indexes.load()[1] or {}).get(name)
        if one is None:
            raise StorageError(f"no index {name!r}")
        match = F.get_json_object("payload", dialect.json_path(*one["path"])) == value
        return self._hits(one, value).where(match)

    def _hits(self, one: dict, value: str) -> DataFrame:
        """The records that an index names for a value, and those that came after it. Few are sought by their offsets,
        which the statistics of the segments' row groups know; more are joined, by offsets alone."""
        rows = self.log.read(one["stream"])
        hits = self.spark.read.parquet(one["at"]).where(F.col("value") == value).select(F.col("offset").alias("__o"))
        few = [r[0] for r in hits.limit(SOUGHT + 1).collect()]
        later = F.col("offset") >= self._upto(one)
        if len(few) <= SOUGHT:
            return rows.where(F.col("offset").isin(few) | later)
        return rows.where(~later).join(hits, F.col("offset") == F.col("__o"), "left_semi").unionByName(rows.where(later))

    def answer(self, text: str) -> str:
        """`query`, or the error as it goes to a client, as JSON."""
        try:
            return json.dumps(self.query(text), default=str)
        except StreamError as e:
            return json.dumps(e.to_dict())
