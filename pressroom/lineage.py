"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session with local executors only may do without, and gets a folder of its own."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if root:
        return root
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_dir(spark: SparkSession) -> str:
    """A new folder that all executors and the driver see."""
    return f"{shared_root(spark).rstrip('/')}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are no longer reachable, which it does after a collection of the driver's memory."""
    time.sleep(0.2)  # listeners hold the last plan until they have heard of its end
    spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: later steps do not repeat what led to it, and survive a lost executor."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of cut() that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
