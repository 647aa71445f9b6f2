"""Text-like evidence: logs, CSV, JSON, event-log XML, all to one event envelope."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators.timeline import ENVELOPE
from .split import csv_records, json_items

_SAMPLE = 8192


def envelope(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` as the common event envelope; columns not given are null."""
    fields = df.sparkSession.createDataFrame([], ENVELOPE).schema
    return df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def _order() -> Column:
    """A number that grows with the place in the file, for rows straight from a splittable scan.

    It is the megabyte in which the row's split starts, then the row's number in its task:
    unique and in file order without a shuffle, but not dense.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.shiftleft(F.floor(F.col("_metadata.file_block_start") / (1 << 20)).cast("long"), 33) + row


def split_order() -> Column:
    """A number that grows with the place in the file, for records that ``split`` has cut: each has a byte at least."""
    return F.col("block") + F.col("n")


def _first_rows(rows: DataFrame, most: int) -> DataFrame:
    """The first rows of each file."""
    nth = F.row_number().over(Window.partitionBy("source_file").orderBy("seq"))
    return rows.withColumn("__n", nth).filter(F.col("__n") <= most).drop("__n")


def _source(spark: SparkSession, where: Column | None) -> DataFrameReader:
    """A reader, of all files below a folder if only some of them are wanted."""
    return spark.read if where is None else spark.read.option("recursiveFileLookup", True)


def _lines(spark: SparkSession, path: str | Sequence[str], most: int | None = None, where: Column | None = None, separator: str | None = None) -> DataFrame:
    """(source_file, seq, value): lines, or what stands between separators; files are split over tasks.

    ``most`` keeps the first lines of each file; ``where`` is a condition on ``_metadata`` by which
    Spark leaves files out before they are read.
    """
    reader = _source(spark, where)
    files = (reader.option("lineSep", separator) if separator else reader).text(path)
    rows = (files if where is None else files.filter(where)).select(F.col("_metadata.file_path").alias("source_file"), _order().alias("seq"), "value")
    return rows if most is None else _first_rows(rows, most)


def read_log(spark: SparkSession, path: str | Sequence[str], max_lines: int | None = None, where: Column | None = None) -> DataFrame:
    """Envelope of log lines: syslog fields where they parse, else the line itself; blank lines are left out."""
    lines = _lines(spark, path, max_lines, where).withColumn("line", F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))).filter("line <> ''").withColumn("s", C.syslog(F.col("line")))
    plain = F.col("s").isNull()
    return envelope(
        lines,
        source_file=F.col("source_file"),
        seq=F.col("seq"),
        ts_raw=F.when(plain, C.log_timestamp(F.col("line"))).otherwise(F.col("s.ts")),
        severity=C.log_severity(F.col("line")),
        message=F.left(F.when(plain, F.col("line")).otherwise(F.col("s.message")), F.lit(200)),
        host=F.col("s.host"),
        process=F.col("s.process"),
        pid=F.col("s.pid"),
        data=F.when(plain, F.create_map(F.lit("raw"), F.col("line"))).otherwise(F.create_map(F.lit("message"), F.col("s.message"))),
        parser=F.lit("log"),
    )


def sniff(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(delimiter, has header) from the first 8 KB of a CSV file, read through Spark; comma and a header if it can't be told."""
    head = spark.read.text(path).limit(200).collect()
    sample = "\n".join(r[0] for r in head)[:_SAMPLE]
    sniffer = csv.Sniffer()
    try:
        delimiter = sniffer.sniff(sample, delimiters=",;\t|").delimiter
    except csv.Error:
        delimiter = ","
    try:
        return delimiter, sniffer.has_header(sample)
    except csv.Error:
        return delimiter, True


def _first(names: Sequence[str], words: Sequence[str]) -> str | None:
    return next((n for n in names if any(w in n.lower() for w in words)), None)


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, header: bool | None = None, max_rows: int | None = None, multiline: bool = False) -> DataFrame:
    """Envelope of CSV rows: cells stay strings, time and severity columns are found by name.

    ``data`` holds the cells that a row has; short rows have fewer.  Files are split over
    tasks, with ``multiline`` too, where quoted cells may hold line ends (``split.csv_records``).
    """
    found = sniff(spark, path) if delimiter is None or header is None else (delimiter, header)
    delimiter, header = delimiter or found[0], found[1] if header is None else header
    raw = spark.read.option("sep", delimiter).option("header", header).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", multiline).csv(path)
    # The multi-line reading leaves the return of a Windows line end at the last name.
    names = [n.rstrip("\r") for n in raw.columns] if header else [f"col_{i}" for i in range(len(raw.columns))]
    rows = raw.toDF(*[f"c{i}" for i in range(len(names))]) if names else raw
    if multiline:
        records = csv_records(spark, path, delimiter)
        if header:
            records = records.filter("block <> 0 or n <> 0")
        options = {"sep": delimiter, "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
        parsed = F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(names))), options)
        cells = records.select(parsed.alias("__r"), F.col("file").alias("source_file"), split_order().alias("seq")).select("__r.*", "source_file", "seq")
    else:
        cells = rows.select("*", F.col("_metadata.file_path").alias("source_file"), _order().alias("seq"))
    if max_rows is not None:
        cells = _first_rows(cells, max_rows)
    at = {n: F.col(f"c{i}") for i, n in reversed(list(enumerate(names)))}
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), at[n].alias("value")) for n in dict.fromkeys(names)])
    data = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    time, severity = (_first(names, fixed.TIME_WORDS), _first(names, fixed.SEVERITY_COLUMN_WORDS)) if header else (names[0] if names else None, None)
    return envelope(
        cells,
        source_file=F.col("source_file"),
        seq=F.col("seq"),
        ts_raw=F.coalesce(at[time], F.lit("")) if time else F.lit(""),
        severity=C.csv_severity(F.coalesce(at[severity], F.lit("info"))) if severity else F.lit("info"),
        message=C.key_values(data),
        data=data,
        parser=F.lit("csv"),
    )


def _larger(spark: SparkSession, path: str | Sequence[str], where: Column | None) -> bool:
    """Whether a file is larger than a split, by the listing alone."""
    files = _source(spark, where).format("binaryFile").load(path)
    most = (files if where is None else files.filter(where)).agg(F.max("length")).first()[0] or 0
    size = spark.sql("SET spark.sql.files.maxPartitionBytes").first()["value"]
    return most > spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)


def read_json(spark: SparkSession, path: str | Sequence[str], max_items: int | None = None, where: Column | None = None, split: bool | None = None) -> DataFrame:
    """Envelope of the items of a JSON document whose root is an array; other roots give no events.

    Documents no larger than a split are a row each.  Larger ones, or all with ``split``, are cut
    into items in parallel (``split.json_items``); seq then grows with the place but is not dense.
    """
    if _larger(spark, path, where) if split is None else split:
        found = json_items(spark, path, where).select(F.col("file").alias("source_file"), split_order().alias("seq"), F.try_parse_json("text").alias("item")).filter("item is not null")
        items = found if max_items is None else _first_rows(found, max_items)
    else:
        docs = _source(spark, where).text(path, wholetext=True)
        docs = (docs if where is None else docs.filter(where)).select(F.col("_metadata.file_path").alias("source_file"), F.try_parse_json("value").alias("v"))
        items = docs.filter(F.schema_of_variant("v").startswith("ARRAY")).select("source_file", F.posexplode(F.variant_get("v", "$", "array<variant>")).alias("seq", "item"))
        if max_items is not None:
            items = items.filter(F.col("seq") < max_items)
    at = lambda key: F.try_variant_get("item", f"$['{key}']", "string")
    first = lambda keys: F.coalesce(*[at(k) for k in keys])
    return envelope(
        items,
        source_file=F.col("source_file"),
        seq=F.col("seq"),
        ts_raw=F.coalesce(first(fixed.JSON_TIME_KEYS), F.lit("")),
        severity=F.coalesce(first(fixed.JSON_SEVERITY_KEYS), F.lit("info")),
        message=F.left(F.coalesce(first(fixed.JSON_EVENT_KEYS), F.left(F.to_json("item"), F.lit(200))), F.lit(200)),
        data=F.create_map(F.lit("item"), F.to_json("item")),
        parser=F.lit("json"),
    )


def json_structure(value, depth: int = 0, most_depth: int = 5, most_keys: int = 20):
    """Shape of a parsed JSON value: names of types, counts of list elements, ``most_keys`` keys a level."""
    if depth >= most_depth:
        return "..."
    if isinstance(value, dict):
        return {k: json_structure(v, depth + 1, most_depth, most_keys) for k, v in list(value.items())[:most_keys]}
    if isinstance(value, list):
        return f"[{len(value)} elements]"
    return type(value).__name__


#: Names of kinds by the start of a variant's type.
_KINDS = (("OBJECT", "dict"), ("ARRAY", "list"), ("BIGINT", "int"), ("STRING", "str"), ("BOOLEAN", "bool"), ("VOID", "NoneType"))


def structure(docs: DataFrame, value: str = "v", most_depth: int = 5, most_keys: int = 20) -> DataFrame:
    """(path, depth, kind, n, least, most): the shape of JSON documents, over all of them.

    ``docs`` has a variant a row.  A path is met by ``n`` values of a kind, which have from ``least`` to
    ``most`` keys or elements (null for scalars).  Objects are looked into, at most ``most_keys`` of their keys
    in the order of names, lists are not; from ``most_depth`` on the kind is ``...``.  Each level is one
    pass over the values of the level before, and counts are combined before they are shuffled.
    """
    level, found = docs.filter(F.col(value).isNotNull()).select(F.lit("$").alias("path"), F.col(value).alias("v")), None
    for depth in range(most_depth + 1):
        kind = F.schema_of_variant("v")
        if depth == most_depth:
            rows = level.select("path", F.lit("...").alias("kind"), F.lit(None).cast("int").alias("size"))
        else:
            name = F.coalesce(*[F.when(kind.startswith(k), n) for k, n in _KINDS], F.lit("float"))
            typed = level.select("path", "v", name.alias("kind"))
            fields = F.map_entries(F.variant_get("v", "$", "map<string,variant>"))
            size = F.when(F.col("kind") == "dict", F.size(fields)).when(F.col("kind") == "list", F.size(F.variant_get("v", "$", "array<variant>")))
            rows = typed.select("path", "kind", size.alias("size"))
            inner = typed.filter("kind = 'dict'").select("path", F.explode(F.slice(F.array_sort(fields, lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)), 1, most_keys)).alias("e"))
            level = inner.select(F.concat("path", F.lit("."), "e.key").alias("path"), F.col("e.value").alias("v"))
        counted = rows.groupBy("path", "kind").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most")).select("path", F.lit(depth).alias("depth"), "kind", "n", "least", "most")
        found = counted if found is None else found.unionByName(counted)
    return found


def parse_event_xml(records: DataFrame, xml: str = "xml", unnamed: str | None = None) -> DataFrame:
    """Envelope of event-log records (source_file, seq, xml).

    Records without a System element or that don't parse are left out.  Data elements without
    a name are dropped, or named ``<unnamed><i>`` if that prefix is given; of equal names the last counts.
    """
    schema = "System struct<Provider:struct<_Name:string>,EventID:struct<_VALUE:string>,Level:string,TimeCreated:struct<_SystemTime:string>,Computer:string>,EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"
    parsed = records.withColumn("__e", F.from_xml(F.col(xml), schema, {"valueTag": "_VALUE", "attributePrefix": "_", "mode": "PERMISSIVE"})).filter("__e.System is not null")
    named = F.transform(F.coalesce("__e.EventData.Data", F.array().cast("array<struct<_Name:string,_VALUE:string>>")), lambda d, i: F.struct(F.coalesce(d["_Name"], F.concat(F.lit(unnamed), i.cast("string")) if unnamed else F.lit(None).cast("string")).alias("key"), F.coalesce(d["_VALUE"], F.lit("")).alias("value")))
    kept = F.filter(named, lambda d: d["key"].isNotNull() & (d["key"] != ""))
    last = F.filter(kept, lambda d, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda later: later["key"] == d["key"]))
    return envelope(
        parsed,
        source_file=F.col("source_file"),
        seq=F.col("seq"),
        ts_raw=F.coalesce("__e.System.TimeCreated._SystemTime", F.lit("")),
        ts=F.try_to_timestamp(F.col("__e.System.TimeCreated._SystemTime")).cast("timestamp_ntz"),
        event_code=F.coalesce(F.col("__e.System.EventID._VALUE").try_cast("int"), F.lit(0)),
        severity=C.level_severity(F.coalesce(F.col("__e.System.Level").try_cast("int"), F.lit(4))),
        host=F.col("__e.System.Computer"),
        provider=F.col("__e.System.Provider._Name"),
        data=F.map_from_entries(last),
        parser=F.lit("evtx"),
    )


def filter_codes(events: DataFrame, wanted: str | None) -> DataFrame:
    """Events whose code is in a comma list; blanks are ignored, as are parts that are no number."""
    codes = [int(p) for p in (wanted or "").replace(" ", "").split(",") if p.lstrip("-").isdigit()]
    return events.filter(F.col("event_code").isin(codes)) if codes else events


def read_event_xml(spark: SparkSession, path: str | Sequence[str], codes: str | None = None, max_records: int | None = None, unnamed: str | None = None, where: Column | None = None) -> DataFrame:
    """Envelope of the <Event> elements of text files, however they are laid out: one a line, over several lines, or one after the other.

    Files are split at the elements' ends; of what stands before an end the last start counts.
    ``max_records`` gives the capped reading: five times as many raw records are looked at,
    before the code filter, and so many events returned.
    """
    ends = _lines(spark, path, None, where, "</Event>").withColumn("xml", F.regexp_extract("value", r"(?s)^.*(<Event[\s>].*)$", 1)).filter("xml <> ''")
    lines = ends.select("source_file", "seq", F.concat("xml", F.lit("</Event>")).alias("xml"))
    if max_records is not None:
        lines = _first_rows(lines, 5 * max_records)
    events = filter_codes(parse_event_xml(lines, unnamed=unnamed), codes)
    return events if max_records is None else _first_rows(events, max_records)


def read_tool_output(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Rows of CSV files that an external forensic tool has written, non-empty cells only, as envelopes."""
    rows = read_csv(spark, path, ",", True, max_rows)
    clean = F.transform_keys("data", lambda k, v: F.regexp_replace(k, "^\ufeff", ""))
    return rows.withColumn("data", F.map_filter(clean, lambda k, v: F.trim(v) != "")).withColumn("message", C.key_values(F.col("data")))
