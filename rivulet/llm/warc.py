"""WARC archives: records written by Spark's own committed writer and read back in sequence.

Each record is one gzip member. Archives are files of the shared store, of bounded size. Each is one row of the text
writer, whose end of line is set to a member of its own, a record that ends the archive: so a file is a plain series of
gzip members with a record each, any Hadoop file system will do, and a lost task leaves nothing behind.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import ensure_checkpoint_dir, hash_pair, unplaced

_PIECE = 1 << 16
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def _base32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record(kind: str, page_id: int | None, url: str | None, size: int, digest: bytes, payload: bytes = b"", refers_to: int | None = None) -> bytes:
    """One WARC record as a gzip member. A revisit holds the HTTP head alone and names the record it repeats."""
    block = _HTTP + b"Content-Length: %d\r\n\r\n" % size + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_base32(digest)}",
        f"WARC-Block-Digest: {_base32(hashlib.sha1(block).digest())}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


def end_record() -> bytes:
    """The member that ends each archive: a metadata record, the same for all of them."""
    block = b"end-of-archive: true\r\n"
    lines = [
        "WARC/1.1", "WARC-Type: metadata", "WARC-Record-ID: <urn:archive:end>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/warc-fields",
        f"WARC-Block-Digest: {_base32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class WarcError(ValueError):
    """An archive whose gzip members, framing or digests do not hold."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    http_length: int | None = field(default=None)
    payload: bytes = field(default=b"")


def members(data: bytes) -> Iterator[Iterator[bytes]]:
    """The gzip members of an archive in order, each as an iterator over inflated pieces; it must be read to its end."""
    at, n = 0, len(data)
    while at < n:
        inflate = zlib.decompressobj(31)
        state = [at]

        def pieces(inflate=inflate, state=state) -> Iterator[bytes]:
            while not inflate.eof:
                chunk = inflate.unconsumed_tail
                if not chunk:
                    chunk = data[state[0] : state[0] + _PIECE]
                    state[0] += len(chunk)
                if not chunk:
                    raise WarcError("the archive ends inside a gzip member")
                try:
                    out = inflate.decompress(chunk, _PIECE)
                except zlib.error as e:
                    raise WarcError(f"bad gzip member: {e}") from e
                if out:
                    yield out

        yield pieces()
        if not inflate.eof:
            raise WarcError("a member was not read to its end")
        at = state[0] - len(inflate.unused_data)


def read_record(pieces: Iterator[bytes]) -> Record | None:
    """The record of one member, framed by Content-Length and verified by its digests; None for an empty member."""
    buffer = bytearray()
    for piece in pieces:
        buffer += piece
        if (end := buffer.find(b"\r\n\r\n")) >= 0:
            break
    else:
        if buffer:
            raise WarcError("no end of the WARC header")
        return None
    lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        length = int(headers["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no content length") from e
    del buffer[: end + 4]
    for piece in pieces:
        buffer += piece
        if len(buffer) > length + 4:
            raise WarcError("the record is longer than its content length")
    if len(buffer) != length + 4 or buffer[length:] != b"\r\n\r\n":
        raise WarcError("the record does not end at its content length")
    out = Record(headers, bytes(buffer[:length]))
    if (want := headers.get("warc-block-digest")) and want != _base32(hashlib.sha1(out.block).digest()):
        raise WarcError("the block does not match its digest")
    if not headers.get("content-type", "").startswith("application/http"):
        return out
    head, mark, out.payload = out.block.partition(b"\r\n\r\n")
    if not mark:
        raise WarcError("no end of the HTTP header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    out.http_length = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
    if headers.get("warc-type") != "revisit":
        if out.http_length is not None and out.http_length != len(out.payload):
            raise WarcError("the payload does not match its HTTP length")
        if (want := headers.get("warc-payload-digest")) and want != _base32(hashlib.sha1(out.payload).digest()):
            raise WarcError("the payload does not match its digest")
    return out


def read_archive(data: bytes) -> Iterator[Record]:
    for pieces in members(data):
        if (r := read_record(pieces)) is not None:
            yield r


def first_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Rows (b1, b2, first): for each payload of at least `min_bytes` bytes that several rows hold, named by two hashes of
    its SHA-1, the (page_id, url) that is its response: the largest, nulls being smallest. Partial maxima only."""
    narrow = pages.where(F.octet_length("html") >= min_bytes).select("page_id", "url", F.sha1(F.encode("html", "UTF-8")).alias("digest"))
    order = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", F.col("url").isNotNull().alias("placed"), "url")
    best = narrow.groupBy(*hash_pair(F.col("digest"))).agg(F.max(order).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    return best.toDF("b1", "b2", "first", "n").drop("n")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000, per_file: int = 2000, file_bytes: int = 8 << 20) -> None:
    """Write a record for each row of `pages` (page_id, url, html; null html: an empty payload) as archives in `path`.

    Of rows with equal payloads of at least `min_bytes` bytes that with the largest page_id is a response, and the
    others revisit it; a null id is smaller than any, among rows with one id the largest url counts, and exactly
    repeated rows are repeated records. Which record a row becomes is decided by its payload, so rows that share an id
    keep theirs. An archive has at most `per_file` records and about `file_bytes` bytes, of which a task holds one at a
    time. Payloads are packed before rows move, so what is shuffled is as small as the archives; rows and first records
    are both exchanged, so a payload that a third of all pages hold is split.
    """
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = []
                for i, u, h in batch.iloc[at : at + 512].itertuples(index=False, name=None):
                    payload = b"" if h is None else h.encode("utf-8", "surrogatepass")
                    i, digest = _int(i), hashlib.sha1(payload).digest()
                    rows.append((i, u, len(payload), digest, digest.hex(), record("response", i, u, len(payload), digest, payload)))
                out = pd.DataFrame(rows, columns=["page_id", "url", "size", "digest", "hex", "member"])
                yield out.astype({"page_id": "Int64"})

    def archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for i, u, n, digest, member, again, refers in batch.itertuples(index=False, name=None):
                member = record("revisit", _int(i), u, int(n), bytes(digest), refers_to=_int(refers)) if again else bytes(member)
                held.append(member)
                size += len(member)
                if len(held) >= per_file or size >= file_bytes:
                    yield pd.DataFrame({"value": [b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"value": [b"".join(held)]})

    h1, h2 = hash_pair(F.col("hex"))
    ready = pages.select("page_id", "url", "html").mapInPandas(packed, "page_id long, url string, size long, digest binary, hex string, member binary").withColumns({"h1": h1, "h2": h2})
    best = unplaced(first_records(pages, min_bytes), "b1", "b2")
    planned = unplaced(ready, "h1", "h2").join(best, (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2")), "left")
    again = F.col("b1").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url")))
    rows = planned.select("page_id", "url", "size", "digest", F.when(~again, F.col("member")).alias("member"), again.alias("again"), F.col("first.page_id").alias("refers"))
    out = rows.mapInPandas(archives, "value binary").select(F.col("value").cast("string"))
    writer = out.write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", end_record().decode("latin-1"))
    writer.option("maxRecordsPerFile", 1).text(path)


def _int(x) -> int | None:
    return None if pd.isna(x) else int(x)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of all archives in `path`.

    A file is read by one task, members in sequence; Spark hands it over whole, so archives should be of the size that
    `write_archives` makes. Digests are lower-case hex SHA-1; those of revisits and their sizes come from the headers,
    as their payload is empty. Other kinds of records are passed over. A broken archive raises WarcError.
    """
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for r in read_archive(data):
                    h = r.headers
                    if h.get("warc-type") not in ("response", "revisit"):
                        continue
                    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    rows.append((_page(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], _page(h.get("warc-refers-to")), r.http_length, digest, r.payload))
                    if len(rows) == 256:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(go, schema)


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def archive_path(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
