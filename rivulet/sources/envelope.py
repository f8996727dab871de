"""The envelope: the columns that every stream has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = T.StructType([
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("subject", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
])
RECORD = [f.name for f in ENVELOPE if f.name != "offset"]

def _as(x: Column | str | None, default: Column) -> Column:
    return default if x is None else F.col(x) if isinstance(x, str) else x


def to_stream(df: DataFrame, *, offset: Column | str, timestamp: Column | str, subject: Column | str | None = None, key: Column | str | None = None, payload: Column | str | None = None, headers: Column | str | None = None) -> DataFrame:
    """A table as a stream: every argument is a column or a column's name. No payload: all columns as one JSON object."""
    empty = F.expr("cast(map() as map<string,string>)")
    return df.select(
        _as(offset, F.lit(None)).cast("bigint").alias("offset"),
        _as(timestamp, F.lit(None)).cast("timestamp").alias("timestamp"),
        _as(subject, F.lit("")).cast("string").alias("subject"),
        _as(key, F.lit(None)).cast("string").alias("key"),
        _as(payload, F.to_json(F.struct(*df.columns))).cast("string").alias("payload"),
        _as(headers, empty).cast("map<string,string>").alias("headers"),
    )


def from_rows(df: DataFrame, stream: str) -> DataFrame:
    """Result rows as records (without offset): the row as JSON; key and subject from columns of these names."""
    has = {c.lower(): c for c in df.columns}
    pick = lambda name, default: F.col(f"`{has[name]}`").cast("string") if name in has else default
    stamp = F.col(f"`{has['timestamp']}`") if dict(df.dtypes).get(has.get("timestamp", ""), "").startswith("timestamp") else F.current_timestamp()
    return df.select(
        stamp.cast("timestamp").alias("timestamp"), F.coalesce(pick("subject", F.lit(None)), F.lit(stream)).alias("subject"), pick("key", F.lit(None).cast("string")).alias("key"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("payload"), F.expr("cast(map() as map<string,string>)").alias("headers"),
    )
