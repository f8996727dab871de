"""Shared pieces of the training-data operators: table access, white space, identity keys, durable cuts."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract, [\x20\x09-\x0D].
WS = " \t\n\x0b\f\r"
WS_CLASS = "[\\x20\\x09-\\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Bind `value` once and use it many times in `body` without the optimiser repeating the work."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def words(c: Column) -> Column:
    """Array of the [^\\x20\\x09-\\x0D]+ runs of a text; null and blank texts give an empty array."""
    s = strip_ws(F.coalesce(c, F.lit("")))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, WS_CLASS + "+"))


def n_words(c: Column) -> Column:
    s = strip_ws(F.coalesce(c, F.lit("")))
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, WS_CLASS + "+"))).cast("long")


def hash_pair(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: together a 128-bit key, so that collisions need not be considered."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x9E3779B9), *cols)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; one of our own only where none is set and all runs on one machine."""
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "rivulet-checkpoints")
    spark.sparkContext.setCheckpointDir(where)
    return spark.sparkContext.getCheckpointDir() or where


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there: lineage ends, lost executors cost nothing.

    A checkpoint hands on the size that its plan was estimated at. Joins multiply estimates, so over the rounds of a
    loop they become numbers of millions of digits, which the driver has no room for. The written rows are therefore
    taken as a plan of their own, with no estimate; adaptive execution goes by the sizes that it finds.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    written = df._jdf.checkpoint(True)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(written.queryExecution().toRdd(), written.schema(), False), spark)


def release(spark: SparkSession) -> None:
    """Let go of what earlier steps shuffled and checkpointed: Spark deletes it once the driver has collected its garbage,
    which a driver with little to do puts off for long."""
    gc.collect()
    spark._jvm.System.gc()


def unplaced(df: DataFrame, *names: str) -> DataFrame:
    """Forget the known partitioning on the long columns `names`.

    A join then exchanges this side as well, and adaptive execution may split a skewed key; it cannot
    where one side keeps the partitioning of an earlier aggregate.
    """
    return df.withColumns({n: F.col(n).bitwiseXOR(F.lit(0).cast("long")) for n in names})


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
