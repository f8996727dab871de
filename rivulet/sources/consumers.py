"""Consumers: cursors over a stream with acknowledgements, retries and a dead-letter stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.errors import StorageError
from rivulet.functions.scalar import subject_matches
from rivulet.sources.fs import Versions
from rivulet.sources.log import Log, valid_name

#: Deliveries after which a record goes to the dead-letter stream.
MAX_ATTEMPTS = 5
BATCH = 100


class Consumer:
    """A named cursor. Records are delivered in order from the cursor on; acknowledging moves it forward."""

    def __init__(self, log: Log, name: str, stream: str, subject: str = "", start: int | str = "earliest"):
        self.log, self.name, self.stream = log, valid_name(name), stream
        self._versions = Versions(log.files, f"{log.root}/consumers/{self.name}")
        self._version, state = self._versions.load()
        if state is None:
            earliest, after = log.bounds(stream)
            at = earliest if start == "earliest" else after if start == "latest" else log.seek(stream, F.lit(start).cast("timestamp")) if isinstance(start, str) else start
            state = {"stream": stream, "subject": subject, "offset": at, "failures": {}}
            self._save(state)
        elif state["stream"] != stream:
            raise StorageError(f"consumer {name!r} reads {state['stream']!r}")
        self.state = state

    def _save(self, state: dict) -> None:
        self._version = self._versions.save(self._version, state)
        self.state = state

    @property
    def offset(self) -> int:
        return self.state["offset"]

    def poll(self, count: int = BATCH) -> DataFrame:
        return self.log.fetch(self.stream, self.offset, count, self.state["subject"])

    def ack(self, offset: int) -> None:
        """Everything up to `offset` is done; the cursor never moves back."""
        done = max(self.offset, offset + 1)
        self._save(self.state | {"offset": done, "failures": {k: v for k, v in self.state["failures"].items() if int(k) >= done}})

    def nack(self, offset: int) -> bool:
        """Count a failure; at the fifth the record goes to `<stream>-dlq`, the cursor passes it, and True is returned."""
        n = self.state["failures"].get(str(offset), 0) + 1
        if n < MAX_ATTEMPTS:
            self._save(self.state | {"failures": self.state["failures"] | {str(offset): n}})
            return False
        row = self.log.read(self.stream).where(F.col("offset") == offset)
        self.log.append(f"{self.stream}-dlq", dead_letters(row, self.stream, self.name, n))
        self.ack(offset)
        return True

    def seek(self, offset: int) -> None:
        self._save(self.state | {"offset": offset, "failures": {}})

    def delete(self) -> None:
        self.log.files.delete(self._versions.folder)


def dead_letters(rows: DataFrame, stream: str, consumer: str, failures: int) -> DataFrame:
    """Records as they go to a dead-letter stream, with headers that say where they come from."""
    own = {"x-original-stream": F.lit(stream), "x-original-offset": F.col("offset").cast("string"), "x-original-subject": F.col("subject"), "x-original-key": F.coalesce("key", F.lit("")), "x-failure-count": F.lit(str(failures)), "x-consumer": F.lit(consumer)}
    added = F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)])
    rest = F.map_filter("headers", lambda k, v: ~k.isin(*own))
    return rows.withColumn("headers", F.map_concat(rest, added)).select("timestamp", "subject", "key", "payload", "headers")


def member_of(key: str, members: int, offset: str = "offset"):
    """The group member that gets a record: by the key's hash, keyless records in turn."""
    return F.pmod(F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.col(offset)), F.lit(members)).cast("int")


def routed(rows: DataFrame, members: int, subject: str = "") -> DataFrame:
    return rows.where(subject_matches("subject", subject)).withColumn("member", member_of("key", members))
