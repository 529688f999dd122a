"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: set[str] = set()


def build_session(app: str = "tideline", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitted session is used instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDELINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without that setting, as in tests, gets a folder of its own, named by its
    application and deleted when the program ends; on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"tideline-{spark.sparkContext.applicationId}")
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later uses see the same rows."""
    path = shared_table_path(df.sparkSession, "table")
    df.write.mode("errorifexists").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Empty tables that :func:`materialise` wrote and no later step reads, so that rounds leave nothing behind."""
    for table in tables:
        table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(table._written_to)


def release(spark: SparkSession) -> None:
    """Let go of what jobs that are over left behind: their plans, broadcasts and shuffle files.

    Spark drops these when the driver collects its garbage, and a driver with room left puts that off
    until its heap has grown to the limit. Called between the steps of a query with many of them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tideline/{label}-{uuid.uuid4().hex}"
