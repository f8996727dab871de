"""Small files and folders on whatever file system Spark knows, through Hadoop's own client."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from rivulet.errors import StorageError


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        if not fs.rename(p, self._jvm.org.apache.hadoop.fs.Path(new)):
            raise StorageError(f"cannot move {old} to {new}")

    def write(self, path: str, text: str, overwrite: bool = False) -> None:
        """Create a file; without `overwrite` an existing one is an error, so that two writers cannot both win."""
        fs, p = self._at(path)
        try:
            out = fs.create(p, overwrite)
        except Exception as e:
            raise StorageError(f"cannot create {path}: another writer may have been first") from e
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        source = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()


class Versions:
    """A JSON document kept as numbered versions in a folder; each change is one new file."""

    KEEP = 5

    def __init__(self, files: Files, folder: str):
        self.files, self.folder = files, folder

    def _numbers(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.files.names(self.folder) if n.startswith("v") and n.endswith(".json"))

    def load(self) -> tuple[int, dict | None]:
        found = self._numbers()
        return (found[-1], json.loads(self.files.read(f"{self.folder}/v{found[-1]:012d}.json"))) if found else (0, None)

    def save(self, after: int, value: dict) -> int:
        new = after + 1
        at = f"{self.folder}/v{new:012d}.json"
        self.files.write(at + ".tmp", json.dumps(value), overwrite=True)
        if self.files.exists(at):
            raise StorageError(f"{self.folder} was changed by another writer")
        self.files.rename(at + ".tmp", at)
        for old in self._numbers()[: -self.KEEP]:
            self.files.delete(f"{self.folder}/v{old:012d}.json")
        return new
