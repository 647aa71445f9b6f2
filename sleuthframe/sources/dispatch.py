"""Reads a folder of mixed evidence: each file by the reader of its extension, one envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from . import binary, text

#: Readers by extension; every other file is read as text lines.
READERS = {".csv": "csv", ".json": "json", ".pf": "prefetch", ".lnk": "lnk", ".sqlite": "browser", ".db": "browser", ".evtx": "evtx"}
_HISTORY_NAMES = ("history", "places.sqlite")
#: The names whose reader is csv.
_CSV_NAMES = "*[!.].[cC][sS][vV]"


def reader_of(name):
    """Reader of a file name, as a Column."""
    return F.when(F.lower(name).isin(*_HISTORY_NAMES), "browser").otherwise(C.lookup(C.extension(name), READERS, F.lit("log")))


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Events of all files below ``path``.

    No list of paths leaves Spark but for large CSV files: each reader looks at the whole folder under a condition on the
    file's name, by which Spark leaves the other files out before it reads any.  CSV files are
    sniffed where they are read; large ones are split, and their shapes pass through the driver.
    Binary event logs need an optional package.
    """
    name = F.col("_metadata.file_name")
    of = lambda reader: reader_of(name) == reader
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    there = {r["reader"] for r in listed.select(reader_of(name).alias("reader")).distinct().collect()}
    parts = []
    if "log" in there:
        parts.append(text.read_log(spark, path, where=of("log")))
    if "json" in there:
        parts.append(text.read_json(spark, path, where=of("json")))
    if "csv" in there:
        parts.append(binary.read_csv_files(spark, path, _CSV_NAMES))
    for reader, fn in (("prefetch", binary.prefetch_events), ("lnk", binary.shortcut_events), ("browser", binary.history_events), ("evtx", binary.read_evtx)):
        if reader in there:
            parts.append(fn(binary.read_files(spark, path, where=of(reader))))
    out = text.envelope(spark.createDataFrame([], "x int"))
    for p in parts:
        out = out.unionByName(p)
    return out
