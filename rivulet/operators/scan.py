"""Scans: filters and columns reach the Parquet reader; order and limits become top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan(stream: DataFrame, columns: list[Column | str] | None = None, where: Column | None = None, start: int | None = None) -> DataFrame:
    """Records from `start` on that satisfy `where`, with the columns asked for."""
    out = stream if start is None else stream.where(F.col("offset") >= start)
    out = out if where is None else out.where(where)
    return out if columns is None else out.select(*columns)


def reverse_tail(stream: DataFrame, count: int, skip: int = 0, where: Column | None = None) -> DataFrame:
    """The `count` newest records that satisfy `where`, newest first, after `skip`: an exact top-n, never a guess at
    how many records to look at."""
    out = scan(stream, where=where).orderBy(F.desc("offset"))
    return (out.offset(skip) if skip else out).limit(count)


def top_n(rows: DataFrame, order: list[Column], count: int, skip: int = 0) -> DataFrame:
    out = rows.orderBy(*order)
    return (out.offset(skip) if skip else out).limit(count)


def key_lookup(stream: DataFrame, key: str) -> DataFrame:
    """Records of one key; Parquet bloom filters on `key` skip row groups without it."""
    return stream.where(F.col("key") == key)


def index_scan(stream: DataFrame, index: DataFrame, value: str, recheck: Column | None = None) -> DataFrame:
    """Records whose indexed field has `value`, by a semi join with an index (value, offset)."""
    hits = index.where(F.col("value") == value).select(F.col("offset").alias("__o"))
    out = stream.join(hits, stream["offset"] == hits["__o"], "left_semi")
    return out if recheck is None else out.where(recheck)
