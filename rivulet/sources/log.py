"""The log store: streams of records with dense offsets, kept as immutable Parquet segments.

A stream is a folder. Each append writes one segment beside the others; then a manifest that lists it with its offsets
and times is saved, which is the commit; then the segment is moved to the others. Whoever reads the manifest first after
a crash in between finishes the move. So bounded readers, who take a manifest once, and unbounded ones, who find
segments as files, see whole appends only, and the same ones. There is one writer for each stream at a time; a manifest
that somebody else changed is an error.
"""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.errors import StorageError
from rivulet.functions.scalar import subject_matches
from rivulet.sources.envelope import ENVELOPE, RECORD
from rivulet.sources.fs import Files, Versions

_NAME = re.compile(r"[A-Za-z0-9_-]{1,255}\Z")
#: Header that holds a message's own id for idempotent publishing.
MESSAGE_ID = "x-idempotency-key"


def valid_name(name: str) -> str:
    if not _NAME.match(name):
        raise StorageError(f"bad stream name {name!r}: 1 to 255 of A-Z a-z 0-9 _ -")
    return name


@dataclass(frozen=True)
class StreamConfig:
    """Retention by age and size, and the window of idempotent publishing; 0 takes the default."""

    max_age_secs: int = 604_800
    max_bytes: int = 10_000_000_000
    dedup_window_secs: int = 300
    dedup_max_entries: int = 500_000

    def __post_init__(self):
        for name, field in self.__dataclass_fields__.items():
            if not getattr(self, name):
                object.__setattr__(self, name, field.default)
        if self.dedup_window_secs > self.max_age_secs:
            raise StorageError("the dedup window must not exceed the retention")


class Log:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    # -- streams ------------------------------------------------------------------------------------------------
    def _folder(self, stream: str) -> str:
        return f"{self.root}/streams/{valid_name(stream)}"

    def _versions(self, stream: str) -> Versions:
        return Versions(self.files, f"{self._folder(stream)}/manifest")

    def _manifest(self, stream: str) -> tuple[int, dict]:
        version, value = self._versions(stream).load()
        if value is None:
            raise StorageError(f"no stream {stream!r}")
        self._finish(value)
        return version, value

    def _finish(self, manifest: dict) -> None:
        """Move the last segment to its place, if the writer died before it could."""
        last = manifest["segments"][-1] if manifest["segments"] else {}
        if "staged" in last and not self.files.exists(last["path"]) and self.files.exists(last["staged"]):
            self._place(last)

    def _place(self, segment: dict) -> None:
        self.files.make(segment["path"].rsplit("/", 1)[0])
        self.files.rename(segment["staged"], segment["path"])

    def create(self, stream: str, config: StreamConfig | None = None) -> None:
        """Make the stream if it isn't there; a config given for an existing one replaces its config."""
        versions = self._versions(stream)
        version, value = versions.load()
        if value is None:
            versions.save(0, {"next": 0, "earliest": 0, "segments": [], "config": (config or StreamConfig()).__dict__})
        elif config:
            versions.save(version, value | {"config": config.__dict__})

    def streams(self) -> list[str]:
        return self.files.names(f"{self.root}/streams")

    def exists(self, stream: str) -> bool:
        return bool(_NAME.match(stream)) and self.files.exists(f"{self._folder(stream)}/manifest")

    def delete(self, stream: str) -> None:
        self.files.delete(self._folder(stream))

    def config(self, stream: str) -> StreamConfig:
        return StreamConfig(**self._manifest(stream)[1]["config"])

    def bounds(self, stream: str) -> tuple[int, int]:
        """(earliest offset, next offset)."""
        _, m = self._manifest(stream)
        return m["earliest"], m["next"]

    # -- writing ------------------------------------------------------------------------------------------------
    def marked(self, stream: str, mark: str) -> int | None:
        """The number that an append with this `mark` had last."""
        return self._manifest(stream)[1].get("marks", {}).get(mark)

    def append(self, stream: str, records: DataFrame, order: list[str | Column] | None = None, mark: tuple[str, int] | None = None) -> tuple[int, int]:
        """Append `records` (timestamp, subject, key, payload, headers; absent ones get defaults) and return the first
        offset and the next one. Offsets follow `order` (the time by default), ties broken by the record's content.

        The rows are range-partitioned and sorted once; offsets are then a partition's start plus the place in it, so
        nothing is numbered in one task and the driver only sees a count for each partition. `mark` is a name and a
        growing number that are committed with the records; an append with a number that was committed does nothing.
        """
        self.create(stream)
        version, m = self._manifest(stream)
        if mark and m.get("marks", {}).get(mark[0], -1) >= mark[1]:
            return m["next"], m["next"]
        if mark:
            m = m | {"marks": m.get("marks", {}) | {mark[0]: mark[1]}}
        rows = records.withColumns({
            "timestamp": (F.coalesce(F.col("timestamp").cast("timestamp"), F.current_timestamp()) if "timestamp" in records.columns else F.current_timestamp()),
            "subject": (F.coalesce(F.col("subject"), F.lit(stream)) if "subject" in records.columns else F.lit(stream)),
            "key": F.col("key").cast("string") if "key" in records.columns else F.lit(None).cast("string"),
            "payload": F.col("payload").cast("string") if "payload" in records.columns else F.lit(None).cast("string"),
            "headers": F.coalesce(F.col("headers"), F.expr("cast(map() as map<string,string>)")) if "headers" in records.columns else F.expr("cast(map() as map<string,string>)"),
        })
        by = [F.col(c) if isinstance(c, str) else c for c in (order or ["timestamp"])]
        ties = [F.xxhash64("subject", "key", "payload")]
        keyed = rows.select(*RECORD, *[c.alias(f"__o{k}") for k, c in enumerate(by + ties)])
        names = [f"__o{k}" for k in range(len(by) + 1)]
        dealt = keyed.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)
        placed = dealt.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
        placed = placed.persist(StorageLevel.DISK_ONLY)
        try:
            found = placed.groupBy("__p").agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).orderBy("__p").collect()
            total = sum(r["n"] for r in found)
            if not total:
                if mark:
                    self._versions(stream).save(version, m)
                return m["next"], m["next"]
            counts = {r["__p"]: r["n"] for r in found}
            starts = list(accumulate((counts.get(k, 0) for k in range(max(counts))), initial=m["next"]))
            start = F.get(F.lit(starts).cast("array<long>"), F.col("__p"))
            name = f"{m['next']:020d}-{uuid.uuid4().hex[:8]}"
            path = f"{self._folder(stream)}/staged/{name}"
            out = placed.select((start + F.col("__i")).cast("bigint").alias("offset"), *RECORD)
            out.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", "100000").parquet(path)
        finally:
            placed.unpersist()
        segment = {
            "path": f"{self._folder(stream)}/segments/{name}", "staged": path, "base": m["next"], "next": m["next"] + total, "bytes": self.files.size(path),
            "lo": min(r["lo"] for r in found).timestamp(), "hi": max(r["hi"] for r in found).timestamp(),
        }
        self._versions(stream).save(version, m | {"next": m["next"] + total, "segments": [*m["segments"], segment]})
        self._place(segment)
        return m["next"], m["next"] + total

    def publish(self, stream: str, records: DataFrame, msg_id: str = "msg_id", now: Column | None = None) -> DataFrame:
        """Idempotent append of `records` with a column of message ids; null ids are always appended.

        Returns rows (msg_id, status, offset) with status 'written', 'duplicate' (same id and payload in the window,
        with the first one's offset) or 'collision' (same id, other payload; not appended). Ids are compared by a
        join with the ids of the window, whatever their number; the rows of a batch with one id count in order of
        time and content, the first being the one that is written.
        """
        self.create(stream)
        window = self.config(stream).dedup_window_secs
        since = (now if now is not None else F.current_timestamp()) - F.make_dt_interval(secs=F.lit(float(window)))
        body = F.xxhash64("payload")
        recent = self.read(stream).where((F.col("timestamp") >= since) & F.col("headers").getItem(MESSAGE_ID).isNotNull())
        recent = recent.groupBy(F.col("headers").getItem(MESSAGE_ID).alias("id")).agg(F.min(F.struct("offset", body.alias("h"))).alias("old"))
        rows = records.withColumns({"__id": F.col(msg_id).cast("string"), "__h": body, "__u": F.xxhash64(*[c for c in records.columns if not c == "headers"])})
        stamp = F.col("timestamp") if "timestamp" in records.columns else F.lit(None).cast("timestamp")
        rows = rows.withColumns({"__t": stamp, "__m": F.monotonically_increasing_id()}).persist(StorageLevel.DISK_ONLY)
        firsts = rows.where(F.col("__id").isNotNull()).groupBy(F.col("__id").alias("fid")).agg(F.min(F.struct("__t", "__u", "__m", "__h")).alias("first"), F.count("*").alias("same"))
        known = firsts.join(recent, F.col("fid") == F.col("id"), "left").select("fid", "first", F.col("old.offset").alias("oo"), F.col("old.h").alias("oh"))
        judged = rows.join(known, F.col("__id") == F.col("fid"), "left")
        leads = (F.col("__t").eqNullSafe(F.col("first.__t"))) & (F.col("__u") == F.col("first.__u")) & (F.col("__m") == F.col("first.__m"))
        against = F.coalesce("oh", "first.__h")
        status = F.when(F.col("__id").isNull() | (F.col("oh").isNull() & leads), "written").when(F.col("__h") == against, "duplicate").otherwise("collision")
        judged = judged.withColumn("__status", status).persist(StorageLevel.DISK_ONLY)
        headers = F.col("headers") if "headers" in records.columns else F.expr("cast(map() as map<string,string>)")
        new = judged.where("__status = 'written'").withColumn("headers", F.when(F.col("__id").isNull(), headers).otherwise(F.map_concat(F.map_filter(headers, lambda k, v: k != MESSAGE_ID), F.create_map(F.lit(MESSAGE_ID), F.col("__id")))))
        base, _ = self.append(stream, new)
        written = self.read(stream).where(F.col("offset") >= base).select(F.col("headers").getItem(MESSAGE_ID).alias("wid"), F.col("offset").alias("wo"))
        out = judged.select("__id", "__status", "oo").join(written.where(F.col("wid").isNotNull()), F.col("__id") == F.col("wid"), "left")
        return out.select(F.col("__id").alias("msg_id"), F.col("__status").alias("status"), F.coalesce("oo", "wo").alias("offset"))

    # -- reading ------------------------------------------------------------------------------------------------
    def read(self, stream: str, since: float | None = None) -> DataFrame:
        """All records that are kept. With `since` (epoch seconds) segments that ended before are not opened."""
        _, m = self._manifest(stream)
        segments = [s for s in m["segments"] if s["next"] > m["earliest"] and (since is None or s["hi"] >= since)]
        whole = [s["path"] for s in segments if "full" not in s]
        parts = [self.spark.read.schema(ENVELOPE).parquet(*whole)] if whole else []
        parts += [self.spark.read.schema(ENVELOPE).parquet(s["path"]).where(F.col("offset") < s["next"]) for s in segments if "full" in s]
        if not parts:
            return self.spark.createDataFrame([], ENVELOPE)
        out = reduce(DataFrame.unionByName, parts)
        return out.where(F.col("offset") >= m["earliest"]) if any(s["base"] < m["earliest"] for s in segments) else out

    def read_stream(self, stream: str, **options: str) -> DataFrame:
        """The stream as an unbounded table: committed segments as they come. Records that were truncated before the
        call are left out; a query that runs meanwhile keeps what it has read."""
        self.create(stream)
        _, m = self._manifest(stream)
        at = f"{self._folder(stream)}/segments"
        if not self.files.names(at):
            self.spark.createDataFrame([], ENVELOPE).write.mode("overwrite").parquet(f"{at}/empty")
        rows = self.spark.readStream.schema(ENVELOPE).options(**options).option("recursiveFileLookup", "true").parquet(at)
        gone = [F.col("_metadata.file_path").contains(s["path"].rsplit("/", 1)[1]) & (F.col("offset") >= s["next"]) for s in m["segments"] if "full" in s]
        return rows.where(~reduce(lambda x, y: x | y, gone)) if gone else rows

    def fetch(self, stream: str, offset: int, count: int, subject: str = "") -> DataFrame:
        """Up to `count` records from `offset` on whose subject matches, in order."""
        rows = self.read(stream).where((F.col("offset") >= offset) & subject_matches("subject", subject))
        return rows.orderBy("offset").limit(count)

    def tail(self, stream: str, count: int) -> DataFrame:
        """The last `count` records, newest first."""
        return self.read(stream).orderBy(F.desc("offset")).limit(count)

    def cuts(self, stream: str) -> list[int]:
        """The offsets at which the stream was truncated, in turn."""
        return self._manifest(stream)[1].get("cuts", [])

    def seek(self, stream: str, at: Column) -> int:
        """The first offset whose time is `at` or later; the next offset if there is none."""
        found = self.read(stream).where(F.col("timestamp") >= at).agg(F.min("offset")).first()[0]
        return self.bounds(stream)[1] if found is None else found

    # -- upkeep -------------------------------------------------------------------------------------------------
    def trim(self, stream: str, before: int) -> None:
        """Drop the records with offsets below `before`."""
        version, m = self._manifest(stream)
        earliest = max(m["earliest"], min(before, m["next"]))
        gone = [s for s in m["segments"] if s["next"] <= earliest]
        self._versions(stream).save(version, m | {"earliest": earliest, "segments": [s for s in m["segments"] if s["next"] > earliest]})
        for s in gone:
            self.files.delete(s["path"])

    def truncate(self, stream: str, at: int) -> None:
        """Drop the records with offsets from `at` on; `at` becomes the next offset."""
        version, m = self._manifest(stream)
        if not m["earliest"] <= at <= m["next"]:
            raise StorageError(f"offset {at} is outside {m['earliest']} to {m['next']}")
        kept = [s if s["next"] <= at else s | {"next": at, "full": s["next"]} for s in m["segments"] if s["base"] < at]
        self._versions(stream).save(version, m | {"next": at, "segments": kept, "cuts": [*m.get("cuts", []), at]})
        for s in m["segments"]:
            if s["base"] >= at:
                self.files.delete(s["path"])

    def retain(self, stream: str, now: float | None = None) -> int:
        """Apply the retention: drop whole segments too old, then the oldest until under max_bytes, never the last.
        Returns the number of segments dropped."""
        version, m = self._manifest(stream)
        config, kept, now = StreamConfig(**m["config"]), list(m["segments"]), time.time() if now is None else now
        while len(kept) > 1 and (kept[0]["hi"] < now - config.max_age_secs or sum(s["bytes"] for s in kept) > config.max_bytes):
            kept.pop(0)
        gone = m["segments"][: len(m["segments"]) - len(kept)]
        if gone:
            self._versions(stream).save(version, m | {"earliest": max(m["earliest"], kept[0]["base"]), "segments": kept})
            for s in gone:
                self.files.delete(s["path"])
        return len(gone)
