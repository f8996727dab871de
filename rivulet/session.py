"""The Spark session and the settings that the engine relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

from rivulet.errors import StorageError


def session(app: str = "rivulet", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Cluster settings win over these where they are given."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    return builder.config(map=base | {k.replace("__", "."): str(v) for k, v in conf.items()}).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names; a local one only where none is set and all runs on one machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not spark.conf.get("spark.checkpoint.dir", None) and not context.master.startswith("local[") and context.master != "local":
            raise StorageError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/rivulet-checkpoints")
    return context.getCheckpointDir()
