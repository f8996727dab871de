"""Materialized views as keyed tables: numbered snapshots with a pointer, replaced whole or merged by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.errors import StorageError
from rivulet.sources.fs import Versions
from rivulet.sources.log import Log, valid_name


class Views:
    def __init__(self, spark: SparkSession, log: Log):
        self.spark, self.log = spark, log
        self.root = f"{log.root}/views"

    def _versions(self, name: str) -> Versions:
        return Versions(self.log.files, f"{self.root}/{valid_name(name)}/pointer")

    def names(self) -> list[str]:
        return self.log.files.names(self.root)

    def exists(self, name: str) -> bool:
        try:
            return self._versions(name).load()[1] is not None
        except StorageError:
            return False

    def _state(self, name: str) -> tuple[int, dict]:
        version, state = self._versions(name).load()
        if state is None:
            raise StorageError(f"no view {name!r}")
        return version, state

    def text(self, name: str) -> str:
        return self._state(name)[1]["text"]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*self._state(name)[1]["paths"])

    def lookup(self, name: str, key: str, column: str | None = None) -> DataFrame:
        """The rows whose key column (the first one if not given) has the text `key`."""
        rows = self.read(name)
        return rows.where(F.col(f"`{column or rows.columns[0]}`").cast("string") == key)

    def write(self, name: str, frame: DataFrame, text: str = "", mark: tuple[str, int] | None = None, more: bool = False) -> None:
        """A new snapshot, or with `more` further rows of the one that is there. Readers of an old snapshot finish on it,
        the one before that goes. `mark`, a name and a growing number, is committed with the rows."""
        versions = self._versions(name)
        version, state = versions.load()
        state = state or {}
        path = f"{self.root}/{name}/data-{uuid.uuid4().hex}"
        frame.write.parquet(path)
        old = state.get("paths", [])
        new = {"paths": [*old, path], "before": state.get("before", [])} if more else {"paths": [path], "before": old}
        marks = state.get("marks", {}) | ({mark[0]: mark[1]} if mark else {})
        versions.save(version, new | {"text": text or state.get("text", ""), "marks": marks})
        for gone in [] if more else state.get("before", []):
            self.log.files.delete(gone)

    def merge(self, name: str, changes: DataFrame, keys: list[str] | None, mark: tuple[str, int] | None = None) -> None:
        """Take in a batch: without keys (None) its rows are further rows; with an empty list of keys, the one row of an
        aggregate of all, they replace what there is; else of each key the changed row if there is one, `changes` having
        one row for each key. A batch whose mark was committed does nothing."""
        if not self.exists(name):
            self.write(name, changes, mark=mark)
            return
        if mark and self._state(name)[1].get("marks", {}).get(mark[0], -1) >= mark[1]:
            return
        if keys is None or not keys:
            if keys is None or changes.limit(1).count():
                self.write(name, changes, mark=mark, more=keys is None)
            return
        old = self.read(name)
        same = [old[k].eqNullSafe(changes[k]) for k in keys]
        cond = same[0]
        for s in same[1:]:
            cond = cond & s
        self.write(name, old.join(changes, cond, "left_anti").unionByName(changes), mark=mark)

    def drop(self, name: str) -> None:
        self.log.files.delete(f"{self.root}/{valid_name(name)}")
