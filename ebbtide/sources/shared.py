"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a local session has none, a new temporary folder.

    A cluster's executors don't see each other's local folders, so there the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ebbtide-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def deleted_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM delete a folder when it ends, also if the session is stopped before."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)


def deleted_now(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = own.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(own, True)
    files.cancelDeleteOnExit(own)
