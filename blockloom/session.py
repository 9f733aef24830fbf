"""Session construction and the settings operators read from it."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "12g", partitions: int | None = None) -> SparkSession:
    """A local session as the tests and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("blockloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def any_session(threads: int = 0) -> SparkSession:
    """The session at hand, or one of the cluster that spark-submit names; local, with so many threads (0: all), only where none is named."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName("blockloom").config("spark.ui.showConsoleProgress", "false")
    if not any(k in os.environ for k in ("MASTER", "SPARK_REMOTE")) and "--master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", "") and "PYSPARK_GATEWAY_PORT" not in os.environ:
        builder = builder.master(f"local[{threads or '*'}]")
    return builder.getOrCreate()


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle width, as a number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a table has fewer files than there are cores; larger tables stay as they are read."""
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    return df.repartition(cores) if 0 < files < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and runs in one process (tests) is a temporary folder set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="blockloom-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that shared_path named, wherever it is."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder; a lost executor loses none of them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Frees the disk of finished steps: Spark deletes shuffle files once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
