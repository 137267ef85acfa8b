"""Tables that a query writes below the shared folder and reads again, so that later stages don't depend on what executors hold."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the setting is absent and the master is this machine, as in tests, a folder of the machine's own is used;
    on a cluster that would lose what other machines wrote, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or os.path.join(tempfile.gettempdir(), "checkpoints")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/quillon/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.work_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete what materialise wrote for these tables, which nothing may read any more."""
    for df in tables:
        drop_work(df.sparkSession, df.work_path)


def drop_work(spark: SparkSession, path: str) -> None:
    """Delete a path that this library wrote, on whatever store holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
