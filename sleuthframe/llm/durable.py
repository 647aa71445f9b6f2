"""Tables that survive the loss of executors: written to the shared checkpoint folder and read again.

A table belongs to the DataFrames that read it.  ``free`` deletes those that no DataFrame of
this driver can reach any more, told by a weak reference to the file index that all plans over a
table share; what can still be read is never deleted, whoever holds it.  The rest goes when the
driver ends.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Session and weak reference (None for folders that no DataFrame stands for) of each path that is there.
_written: dict[str, tuple[SparkSession, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (local tests) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sleuthframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written[path] = (spark, None)
    return path


def materialize(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it: cuts lineage, keeps columnar pruning."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    index = out._jdf.queryExecution().analyzed().relation().location()
    _written[path] = (spark, spark.sparkContext._jvm.java.lang.ref.WeakReference(index))
    out.stored_at = path
    _drop_unreachable()
    return out


def written() -> list[str]:
    """Paths of the tables that are there now."""
    return list(_written)


def discard(path: str) -> None:
    """Delete a table (of ``written``) now: nothing reads it any more."""
    if path in _written:
        spark, _ = _written.pop(path)
        _delete(spark, path)


def _drop_unreachable() -> None:
    for path, (_, index) in list(_written.items()):
        if index is not None and index.get() is None:
            discard(path)


def free(spark: SparkSession) -> None:
    """Delete tables that no DataFrame can read any more, and let Spark drop shuffle files of finished steps now.

    Spark does so only when the driver collects garbage, by default twice an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _drop_unreachable()


class Scratch:
    """Tables of one job, dropped when it is done but for those that its result reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        self.tables.append(materialize(df, name, **options))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables now: nothing reads them any more."""
        for t in tables:
            discard(t.stored_at)
        self.tables = [t for t in self.tables if not any(t is d for d in tables)]

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        self.drop(*[t for t in self.tables if not any(t is k for k in tables)])


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for path, (spark, _) in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended: the folder's owner cleans up
            return
