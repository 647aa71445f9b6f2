"""Folders for files that a job writes and reads again: below spark.checkpoint.dir, deleted when the driver ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; only local sessions without one get a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sleuthframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def rename(spark: SparkSession, path: str, suffix: str, to: str) -> None:
    """Give the few files of a folder that end with ``suffix`` another ending."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(where):
        name = status.getPath().getName()
        if name.endswith(suffix):
            files.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(where, name[: -len(suffix)] + to))


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended: the folder's owner cleans up
            return
