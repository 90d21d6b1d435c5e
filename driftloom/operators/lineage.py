"""Cutting lineage between the rounds of bounded loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, as in tests, a new temporary one, if the master is
    local: on a cluster executors would not see it, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="driftloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_MADE: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder within the shared one. That folder is deleted when the driver ends."""
    folder = f"{shared_folder(spark)}/driftloom-{spark.sparkContext.applicationId}"
    if folder not in _MADE:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _MADE.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: what comes later neither recomputes it nor depends on the
    executors that made it."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
