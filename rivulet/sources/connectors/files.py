"""NDJSON archives in folders by hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_ndjson(rows: DataFrame, path: str, flush_records: int = 1000) -> None:
    """One JSON object a record (offset, timestamp, subject, key, value, headers) under year/month/day/hour folders,
    at most `flush_records` to a file. Rows are ranged by hour and offset: an hour's records are together, so files
    are as few as the records ask for, and a busy hour is cut by offset, so that it is not one task's."""
    parts = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH"}
    out = rows.select(
        "offset", F.unix_micros("timestamp").alias("timestamp"), "subject", "key", F.col("payload").alias("value"), "headers",
        *[F.date_format("timestamp", p).alias(n) for n, p in parts.items()],
    )
    spread = out.repartitionByRange("year", "month", "day", "hour", "offset")
    spread.write.mode("append").partitionBy(*parts).option("maxRecordsPerFile", flush_records).json(path)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    schema = "offset bigint, timestamp bigint, subject string, key string, value string, headers map<string,string>, year string, month string, day string, hour string"
    rows = spark.read.schema(schema).json(path)
    return rows.select("offset", F.timestamp_micros("timestamp").alias("timestamp"), "subject", "key", F.col("value").alias("payload"), "headers", "year", "month", "day", "hour")
