"""Binary evidence: Prefetch, shortcuts, browser history, event-log files, file inventory.

Fixed headers are decoded with Column expressions on ``binaryFile`` content.  Only the
variable-length tail of shortcuts and the SQLite and EVTX containers need Python.
"""

from __future__ import annotations

import hashlib
import sqlite3
import tempfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from . import csvfiles
from .text import envelope, parse_event_xml

#: Files above this size aren't loaded into a row, but digested by chunks of the other size.
MAX_BYTES, CHUNK_BYTES = 256 << 20, 4 << 20


def read_files(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None, where: Column | None = None) -> DataFrame:
    """(path, name, modificationTime, length, content) of all files below a folder, or of those that a condition on ``_metadata`` holds for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    return (files if where is None else files.filter(where)).withColumn("name", C.base_name(F.col("path")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """md5, sha1 and sha256 of files, read once in chunks; memory is one chunk whatever the size."""
    from pyarrow.fs import FileSystem

    for batch in batches:
        out = []
        for path in batch.column("path").to_pylist():
            files, where = FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
            sums = [hashlib.md5(usedforsecurity=False), hashlib.sha1(usedforsecurity=False), hashlib.sha256()]
            with files.open_input_file(where) as stream:
                while chunk := stream.read(CHUNK_BYTES):
                    for s in sums:
                        s.update(chunk)
            out.append([s.hexdigest() for s in sums])
        sums = [pa.array([o[i] for o in out], pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "name", "type", "size_bytes")), *sums], names=["path", "name", "type", "size_bytes", "md5", "sha1", "sha256"])


def inventory(spark: SparkSession, path: str | Sequence[str], most: int = MAX_BYTES) -> DataFrame:
    """(path, name, type, size_bytes, md5, sha1, sha256) of the files of a case, sorted by path.

    Files of up to ``most`` bytes are digested by Spark; larger ones, disk images say, by chunks,
    a file a task.  Their path must be one that Arrow's file systems open.
    """
    files = read_files(spark, path).select("path", "name", C.file_type(F.col("name")).alias("type"), F.col("length").alias("size_bytes"), "length", "content")
    small = files.filter(F.col("length") <= most).select("path", "name", "type", "size_bytes", F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"))
    # The listing without content: Spark opens none of these.
    large = files.select("path", "name", "type", "size_bytes").filter(F.col("size_bytes") > most)
    large = large.repartition("path").mapInArrow(_digests, "path string, name string, type string, size_bytes long, md5 string, sha1 string, sha256 string")
    return small.unionByName(large).orderBy("path")


#: Extensions that may be added to a case.
ALLOWED = tuple(sorted(fixed.FILE_TYPES))


def ingest(files: DataFrame, investigation_id: str, at: Column, uploaded_by: int | None = None) -> DataFrame:
    """Rows for the artifacts table of files with an allowed extension; names are made unique by the time of upload."""
    content, ext = F.col("content"), C.extension(F.col("name"))
    rows = files.filter(ext.isin(*ALLOWED))
    unique = F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), F.regexp_replace("name", r"[^A-Za-z0-9._-]", "_"))
    return rows.select(
        F.xxhash64("path", F.lit(investigation_id)).alias("id"),
        F.lit(investigation_id).alias("investigation_id"),
        unique.alias("filename"),
        F.col("name").alias("original_filename"),
        F.col("path").alias("file_path"),
        F.col("length").alias("file_size"),
        F.md5(content).alias("file_hash_md5"),
        F.sha1(content).alias("file_hash_sha1"),
        F.sha2(content, 256).alias("file_hash_sha256"),
        F.ltrim(ext, F.lit(".")).alias("file_type"),
        F.lit(None).cast("string").alias("analysis_result"),
        F.lit(uploaded_by).cast("long").alias("uploaded_by"),
        at.cast("timestamp_ntz").alias("uploaded_at"),
    )


def csv_events(files: DataFrame) -> DataFrame:
    """Envelope of many CSV files, each with its own dialect and header, sniffed where the file is read.

    ``read_csv_files`` splits the large ones of a folder, ``text.read_csv`` files of one known shape.
    Ragged rows keep the cells that have a header; without a header cells are col_0, col_1, ...
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ((p, c) for batch in batches for p, c in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True))
        yield from csvfiles.event_batches(e for path, content in files for e in csvfiles.whole_events(path, content.as_py()))

    return _csv_envelope(files.select("path", "content").mapInArrow(run, csvfiles.EVENT))


def _csv_envelope(rows: DataFrame) -> DataFrame:
    return envelope(rows, source_file=F.col("source_file"), seq=F.col("seq"), ts_raw=F.col("ts_raw"), severity=C.csv_severity(F.col("level")), message=C.key_values(F.col("data")), data=F.col("data"), parser=F.lit("csv"))


def read_csv_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``csv_events`` of the files below a folder whose names have a pattern; large ones are split, their seq is not dense."""
    whole = csv_events(read_files(spark, path, pattern, F.col("_metadata.file_size") <= csvfiles.WHOLE_BYTES))
    large = csvfiles.split_events(spark, path, pattern)
    return whole if large is None else whole.unionByName(_csv_envelope(large))


def prefetch(files: DataFrame) -> DataFrame:
    """(path, executable, hash, run_count, version, compressed, error) of Prefetch files."""
    content = F.col("content")
    magic = F.substring(content, 1, 3)
    compressed = magic == F.encode(F.lit("MAM"), "US-ASCII")
    valid = F.substring(content, 5, 4) == F.encode(F.lit("SCCA"), "US-ASCII")
    version = C.little_endian(content, 0, 4)
    count = F.when(version <= 23, C.little_endian(content, 0x98, 4)).otherwise(C.little_endian(content, 0xD0, 4))
    name = F.rtrim(F.decode(F.substring(content, 0x11, 60), "UTF-16LE"), F.lit("\x00"))
    ok = valid & ~compressed
    error = F.when(compressed, "compressed: needs a decompressor").when(~valid, "invalid signature")
    return files.select(
        "path",
        F.when(ok, name).alias("executable"),
        F.when(ok, F.lpad(F.upper(F.hex(C.little_endian(content, 0x4C, 4))), 8, "0")).alias("hash"),
        F.when(ok, F.coalesce(count, F.lit(0))).alias("run_count"),
        F.when(ok, version).alias("version"),
        compressed.alias("compressed"),
        error.alias("error"),
    )


def prefetch_events(files: DataFrame) -> DataFrame:
    rows = prefetch(files).filter("error is null")
    return envelope(rows, source_file=F.col("path"), seq=F.lit(0), ts_raw=F.lit(""), event_tag=F.lit("PF"), severity=F.lit("info"), message=F.concat(F.lit("Prefetch: "), "executable", F.lit(" execute "), F.col("run_count").cast("string"), F.lit(" fois")), process=F.col("executable"), data=F.create_map(F.lit("hash"), F.col("hash"), F.lit("run_count"), F.col("run_count").cast("string")), parser=F.lit("prefetch"))


_STRINGS = ((0x4, "name"), (0x8, "relative_path"), (0x10, "working_dir"), (0x20, "arguments"), (0x40, "icon_location"))


def shortcut_strings(data: bytes) -> dict[str, str]:
    """Target path and string data of a valid shortcut, walked from the end of its header."""
    number = lambda at, size: int.from_bytes(data[at : at + size], "little")
    flags, at, out = number(20, 4), 0x4C, {}
    if flags & 0x1:
        at += 2 + number(at, 2)
    if flags & 0x2 and at + 4 <= len(data):
        size = number(at, 4)
        info = data[at : at + size]
        base = int.from_bytes(info[0x10:0x14], "little") if len(info) >= 0x20 else 0
        if 0 < base < len(info):
            end = info.find(b"\x00", base)
            out["target_path"] = info[base : end if end >= 0 else len(info)].decode("latin-1")
        at += size
    wide = bool(flags & 0x80)
    for flag, name in _STRINGS:
        if flags & flag and at + 2 <= len(data):
            size = number(at, 2) * (2 if wide else 1)
            out[name] = data[at + 2 : at + 2 + size].decode("utf-16-le" if wide else "latin-1", "replace")
            at += 2 + size
    if not out.get("target_path"):
        out["target_path"] = out.get("relative_path", "")
    return out


def shortcuts(files: DataFrame) -> DataFrame:
    """(path, target_path, working_dir, arguments, icon_location, created, accessed, written, file_size, flags, severity, error) of .lnk files."""
    fields = ("target_path", "working_dir", "arguments", "icon_location")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shortcut_strings(c) if ok else {} for c, ok in zip(batch.column("content").to_pylist(), batch.column("ok").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array([f.get(n, "") for f in found], pa.string()) for n in fields)], names=["__p", *fields])

    content = F.col("content")
    error = F.when(F.length(content) < 0x4C, "too short").when(C.little_endian(content, 0, 4) != 0x4C, "not a shortcut").when(F.hex(F.substring(content, 5, 16)) != fixed.LNK_CLSID, "wrong class id")
    head = files.select(
        "path",
        content.alias("content"),
        error.isNull().alias("ok"),
        error.alias("error"),
        *[F.when(error.isNull(), C.filetime(_filetime_ticks(content, at))).alias(n) for at, n in ((28, "created"), (36, "accessed"), (44, "written"))],
        F.when(error.isNull(), C.little_endian(content, 52, 4)).alias("file_size"),
        F.when(error.isNull(), C.little_endian(content, 20, 4)).alias("flags"),
    )
    tails = head.select("path", "content", "ok").mapInArrow(run, "__p string, " + ", ".join(f"{n} string" for n in fields))
    blob = F.concat_ws(" ", *fields)
    joined = head.drop("content", "ok").join(tails, F.col("path") == F.col("__p")).drop("__p")
    return joined.withColumn("severity", F.when(F.col("error").isNull(), F.when(C.any_substring(blob, fixed.LNK_SUSPICIOUS), "high").otherwise("low")))


def _filetime_ticks(content: Column, at: int) -> Column:
    """Eight little-endian bytes; values past 2**63 (no real time) count as 0."""
    high, low = C.little_endian(content, at + 4, 4), C.little_endian(content, at, 4)
    return F.when(high < 0x7FFFFFFF, high * F.lit(2**32) + low).otherwise(F.lit(0).cast("long"))


def shortcut_events(files: DataFrame) -> DataFrame:
    rows = shortcuts(files).filter("error is null")
    when = F.coalesce("written", "created")
    return envelope(rows, source_file=F.col("path"), seq=F.lit(0), ts_raw=F.coalesce(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")), ts=when, event_tag=F.lit("LNK"), severity=F.col("severity"), message=F.concat(F.lit("Raccourci vers "), "target_path"), data=F.create_map(F.lit("target_path"), F.col("target_path"), F.lit("arguments"), F.col("arguments")), parser=F.lit("lnk"))


_HISTORIES = {
    "urls": ("chromium", "SELECT url, title, visit_count, last_visit_time FROM urls ORDER BY 4 DESC LIMIT ?"),
    "moz_places": ("firefox", "SELECT url, title, visit_count, last_visit_date FROM moz_places ORDER BY 4 DESC LIMIT ?"),
}


def history_rows(content: bytes, limit: int) -> Iterator[tuple[str, str, str, int, int]]:
    """(browser, url, title, visits, time number) of a history database; ValueError if it is none."""
    with tempfile.TemporaryDirectory() as folder:  # SQLite opens files only; gone again with the row
        path = Path(folder) / "h.sqlite"
        path.write_bytes(content)
        db = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
        try:
            tables = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
            kind = next((k for k in _HISTORIES if k in tables), None)
            if kind is None:
                raise ValueError("no browser history")
            browser, query = _HISTORIES[kind]
            for url, title, visits, at in db.execute(query, (limit,)):
                yield browser, url or "", (title or "")[:200], visits or 0, at or 0
        finally:
            db.close()


def browser_history(files: DataFrame, limit: int = 2**31 - 1) -> DataFrame:
    """(path, seq, browser, url, title, visits, visited_at, error): visits, latest first; files that are none give one error row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    out += [(path, i, *r, None) for i, r in enumerate(history_rows(content, limit))]
                except (sqlite3.DatabaseError, ValueError) as e:
                    out.append((path, 0, None, None, None, None, None, str(e)))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["path", "seq", "browser", "url", "title", "visits", "at", "error"])

    rows = files.select("path", "content").mapInArrow(run, "path string, seq long, browser string, url string, title string, visits long, at long, error string")
    at = F.when(F.col("browser") == "chromium", C.webkit_time(F.col("at"))).otherwise(C.unix_micros_time(F.col("at")))
    return rows.withColumn("visited_at", at).drop("at")


def history_events(files: DataFrame) -> DataFrame:
    rows = browser_history(files).filter("error is null")
    return envelope(rows, source_file=F.col("path"), seq=F.col("seq"), ts_raw=F.coalesce(F.date_format("visited_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("")), ts=F.col("visited_at"), event_tag=F.lit("BR"), severity=F.lit("info"), message=F.col("url"), data=F.create_map(F.lit("url"), F.col("url"), F.lit("title"), F.col("title"), F.lit("visit_count"), F.col("visits").cast("string")), parser=F.lit("browser"))


def read_evtx(files: DataFrame) -> DataFrame:
    """Envelope of binary event logs, by the optional ``evtx`` package (or ``python-evtx``); ImportError without either."""
    try:
        import evtx  # noqa: F401
    except ImportError:
        import Evtx  # noqa: F401

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                records = list(_evtx_records(content))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(records), pa.string()), pa.array(range(len(records)), pa.int64()), pa.array(records, pa.string())], names=["source_file", "seq", "xml"])

    return parse_event_xml(files.select("path", "content").mapInArrow(run, "source_file string, seq long, xml string"))


def _evtx_records(content: bytes) -> Iterator[str]:
    import io

    try:
        import evtx

        for record in evtx.PyEvtxParser(io.BytesIO(content)).records():
            yield record["data"]
    except ImportError:
        import Evtx.Evtx

        with tempfile.NamedTemporaryFile(suffix=".evtx") as f:
            f.write(content)
            f.flush()
            with Evtx.Evtx.Evtx(f.name) as log:
                for record in log.records():
                    yield record.xml()


def byte_patterns(files: DataFrame, patterns: dict[str, bytes], most: int = 10) -> DataFrame:
    """(path, rule, offset, matched): places of literal byte patterns, the first ``most`` of each rule, as hex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for rule, needle in patterns.items():
                    at, n = content.find(needle), 0
                    while at >= 0 and n < most:
                        out.append((path, rule, at, needle.hex()[:100]))
                        at, n = content.find(needle, at + 1), n + 1
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "rule", "offset", "matched"])

    return files.select("path", "content").mapInArrow(run, "path string, rule string, offset long, matched string")
