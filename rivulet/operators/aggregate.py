"""Aggregates: plain, in tumbling windows, as a log of changes, and the latest row of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.interval import micros, spark_interval


def aggregate(rows: DataFrame, by: list[Column], **aggs: Column) -> DataFrame:
    """Grouped, or without `by` global: one row even for no input."""
    wanted = [a.alias(name) for name, a in aggs.items()]
    return rows.groupBy(*by).agg(*wanted) if by else rows.agg(*wanted)


def window_start(ts: Column, size: str) -> Column:
    us = micros(size)
    at = F.unix_micros(ts)
    return F.timestamp_micros(at - F.pmod(at, F.lit(us)))


def tumbling_aggregate(rows: DataFrame, ts: Column, size: str, by: list[Column], watermark: tuple[str, str] | None = None, **aggs: Column) -> DataFrame:
    """Aggregates by tumbling window and keys, with column window_start. On a stream give the time column and the
    lateness as `watermark`."""
    if watermark:
        rows = rows.withWatermark(*watermark)
    out = rows.groupBy(F.window(ts, spark_interval(size)).alias("w"), *by).agg(*[a.alias(n) for n, a in aggs.items()])
    return out.select(F.col("w.start").alias("window_start"), *[c for c in out.columns if c != "w"])


def final_windows(rows: DataFrame, ts: Column, size: str, by: list[Column], grace: str = "5 minutes", **aggs: Column) -> DataFrame:
    """In batch: the windows that a stream in append mode has emitted after all rows, those that ended `grace` or more
    before the newest record."""
    newest = rows.agg(F.max(ts).alias("__newest"))
    out = tumbling_aggregate(rows, ts, size, by, **aggs).crossJoin(F.broadcast(newest))  # one row
    closed = F.unix_micros("window_start") + micros(size) + micros(grace) <= F.unix_micros("__newest")
    return out.where(closed).drop("__newest")


def changelog(rows: DataFrame, ts: Column, size: str, by: list[Column], order: str = "offset", **aggs: Column) -> DataFrame:
    """One row for each record: the aggregates of its window and keys up to and with it."""
    start = window_start(ts, size)
    frame = Window.partitionBy(start, *by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(F.col(order), start.alias("window_start"), *by, *[a.over(frame).alias(n) for n, a in aggs.items()])


def latest_by_key(rows: DataFrame, by: list[Column], order: Column | str = "offset", columns: list[str] | None = None) -> DataFrame:
    """The newest row of each key, by a partial maximum rather than a sort of each key's rows."""
    columns = columns or rows.columns
    best = F.max_by(F.struct(*columns), order).alias("__r")
    return rows.groupBy(*by).agg(best).select("__r.*")
