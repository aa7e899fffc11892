"""Cutting lineage through a table in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a session on one machine (tests) gets a temporary folder
    once; a session on a cluster is refused, as its executors would each write
    to a disk of their own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("docquarry.scratch.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="docquarry-")
        spark.conf.set("docquarry.scratch.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    The files survive the loss of any executor, and the plans built on the
    result start at a column-pruned scan. They go when ``discard`` is called,
    or else when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docquarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = file_system(spark, path)
    files.deleteOnExit(at)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for tables that no later plan reads."""
    for df in tables:
        files, at = file_system(df.sparkSession, df._written_at)
        files.delete(at, True)


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at
