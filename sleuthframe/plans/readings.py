"""Registered queries that run the readers: rows of the driver tables are written as evidence files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import stats
from ..sources import binary, dispatch, staging, text
from . import frames as R
from .catalogue import _severity_sql, query


def _text(spark: SparkSession, lines: DataFrame, name: str, path: str | None = None) -> str:
    path = path or staging.folder(spark, name)
    lines.select("value").write.text(path)
    return path


# --- logs -----------------------------------------------------------------------------


def _log_file(spark, d, path: str | None = None) -> str:
    """Log lines, every third with blanks around it, and blank lines between."""
    lines = R.log_lines(spark, d)
    padded = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("  \t"), "line", F.lit("  "))).otherwise(F.col("line"))
    blank = lines.filter("seq % 7 = 0").select(F.lit("   ").alias("value"))
    return _text(spark, lines.select(padded.alias("value")).union(blank), "log", path)


_SYSLOG = fixed.SYSLOG
_PART = lambda i: f"regexp_extract(line, '{_SYSLOG}', {i})"
_LOG_SQL = f"""(SELECT CASE WHEN s THEN {_PART(1)} ELSE coalesce({", ".join(f"nullif(regexp_extract(line, '{p}', 1), '')" for p in fixed.TIMESTAMPS)}, '') END AS ts_raw, {_severity_sql('line')} AS severity,
    left(CASE WHEN s THEN {_PART(5)} ELSE line END, 200) AS message, CASE WHEN s THEN {_PART(2)} END AS host, CASE WHEN s THEN {_PART(3)} END AS process, CASE WHEN s THEN nullif({_PART(4)}, '') END AS pid, CASE WHEN s THEN '' ELSE line END AS raw, 'log' AS parser
    FROM (SELECT line, regexp_matches(line, '{_SYSLOG}') AS s FROM {R.LINES_SQL}))"""


@query(f"SELECT * FROM {_LOG_SQL}")
def read_log_file(spark, d):
    rows = text.read_log(spark, _log_file(spark, d))
    return rows.select("ts_raw", "severity", "message", "host", "process", "pid", F.coalesce(F.col("data")["raw"], F.lit("")).alias("raw"), "parser")


# --- CSV ------------------------------------------------------------------------------

_LEVELS = ("CRIT", "Warning", "high", "weird")


def _csv_file(spark, d, path: str | None = None) -> str:
    """Events with a time and a level column, semicolons, quotes and empty cells."""
    e = R.events(spark, d)
    level = F.element_at(F.array(*map(F.lit, _LEVELS)), (F.col("user_id") % 4 + 1).cast("int"))
    path = path or staging.folder(spark, "csv")
    rows = e.select(F.col("seq").cast("string").alias("Record"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Event Time"), level.alias("Level"), F.concat(F.lit('say "'), "event_type", F.lit('"; then')).alias("Note"), F.when(F.col("k") % 2 == 0, F.col("user_id").cast("string")).alias("User"), F.lit("z").alias("Sixth"))
    rows.write.option("header", True).option("sep", ";").option("escape", '"').option("nullValue", None).csv(path)
    return path


@query("""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_raw, CASE user_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'info' END AS severity,
    'Record=' || seq || ', Event Time=' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ', Level=' || CASE user_id % 4 WHEN 0 THEN 'CRIT' WHEN 1 THEN 'Warning' WHEN 2 THEN 'high' ELSE 'weird' END || ', Note=say "' || event_type || '"; then, ' || CASE WHEN k % 2 = 0 THEN 'User=' || user_id ELSE 'Sixth=z' END AS message, CAST(CASE WHEN k % 2 = 0 THEN 6 ELSE 5 END AS INTEGER) AS cells, 'csv' AS parser
    FROM """ + R.EVENTS_SQL)
def read_csv_file(spark, d):
    rows = text.read_csv(spark, _csv_file(spark, d))
    return rows.select("ts_raw", "severity", "message", F.size("data").alias("cells"), "parser")


# --- JSON -----------------------------------------------------------------------------

_JSON_FILES = 16
#: Rows of one array: the number of files follows the rows.
_ARRAY_ROWS = 20_000


def _items(spark, d) -> DataFrame:
    """Events as JSON, with ``item``; keys differ between them."""
    e = R.events(spark, d).withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    one = F.to_json(F.struct(F.col("at").alias("timestamp"), F.lit("high").alias("severity"), F.col("event_type").alias("message"), F.col("seq")))
    two = F.to_json(F.struct(F.col("at").alias("created"), F.lit("low").alias("level"), F.col("event_type").alias("description"), F.col("seq")))
    return e.withColumn("item", F.when(F.col("k") % 2 == 0, one).otherwise(two))


def _json_files(spark, d) -> str:
    """Arrays of events, one a file, and a file that holds an object, which gives no events."""
    file = (F.col("seq") % _JSON_FILES) + F.floor(F.col("seq") / (_JSON_FILES * _ARRAY_ROWS)) * (_JSON_FILES + 1)
    # A line an item: no array is a row.
    order = Window.partitionBy("file").orderBy("seq")
    first, last = F.row_number().over(order) == 1, F.lead("seq").over(order).isNull()
    line = F.concat(F.when(first, F.lit("[")).otherwise(F.lit(",")), "item", F.when(last, F.lit("]")).otherwise(F.lit("")))
    arrays = _items(spark, d).withColumn("file", file).select("file", line.alias("value"))
    other = spark.range(1).select(F.lit(_JSON_FILES).cast("long").alias("file"), F.lit('{"timestamp": "x", "items": []}').alias("value"))
    path = staging.folder(spark, "json")
    arrays.write.partitionBy("file").text(path)
    other.write.mode("append").partitionBy("file").text(path)
    return path


_JSON_SQL = "(SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_raw, CASE WHEN k % 2 = 0 THEN 'high' ELSE 'low' END AS severity, event_type AS message, seq, 'json' AS parser FROM " + R.EVENTS_SQL + ")"


@query(f"SELECT * FROM {_JSON_SQL}")
def read_json_files(spark, d):
    rows = text.read_json(spark, _json_files(spark, d))
    return rows.select("ts_raw", "severity", "message", F.get_json_object(F.col("data")["item"], "$.seq").cast("long").alias("seq"), "parser")


@query(f"SELECT count(*) AS n FROM {_JSON_SQL} WHERE seq // {_JSON_FILES} < 0 UNION ALL SELECT sum(least(n, 20)) FROM (SELECT count(*) AS n FROM {R.EVENTS_SQL} GROUP BY seq % {_JSON_FILES}, seq // {_JSON_FILES * _ARRAY_ROWS})")
def read_json_capped(spark, d):
    """The capped reading: the first items of each array; and no events of a file whose root is an object."""
    path = _json_files(spark, d)
    objects = text.read_json(spark, f"{path}/file={_JSON_FILES}").agg(F.count("*").alias("n"))
    return objects.union(text.read_json(spark, path, max_items=20).agg(F.count("*")))


@query(f"""WITH e AS (SELECT k, user_id % 3 AS tags FROM {R.EVENTS_SQL}), n AS (SELECT CAST(count(*) AS BIGINT) AS n, count(*) FILTER (WHERE k % 2 = 0) AS even, count(*) FILTER (WHERE k % 2 = 1) AS odd, CAST(min(tags) AS INTEGER) AS lo, CAST(max(tags) AS INTEGER) AS hi FROM e)
    SELECT path, CAST(depth AS INTEGER) AS depth, kind, n, CAST(least AS INTEGER) AS least, CAST(most AS INTEGER) AS most FROM (
    SELECT '$' AS path, 0 AS depth, 'dict' AS kind, n, 3 AS least, 3 AS most FROM n UNION ALL SELECT '$.deep', 1, 'dict', n, 1, 1 FROM n UNION ALL SELECT '$.deep.a', 2, 'dict', n, 1, 1 FROM n
    UNION ALL SELECT '$.deep.a.b', 3, 'dict', n, 1, 1 FROM n UNION ALL SELECT '$.deep.a.b.c', 4, 'dict', n, 1, 1 FROM n UNION ALL SELECT '$.deep.a.b.c.d', 5, '...', n, NULL, NULL FROM n
    UNION ALL SELECT '$.tags', 1, 'list', n, lo, hi FROM n UNION ALL SELECT '$.value', 1, 'int', even, NULL, NULL FROM n WHERE even > 0 UNION ALL SELECT '$.value', 1, 'str', odd, NULL, NULL FROM n WHERE odd > 0)""")
def read_json_structure(spark, d):
    """The shape of documents whose fields differ in kind and whose lists differ in length."""
    value = F.when(F.col("k") % 2 == 0, F.to_json(F.struct(F.col("k").alias("x")))).otherwise(F.lit('{"x":"odd"}'))
    tags = F.array_join(F.array_repeat(F.lit('"t"'), (F.col("user_id") % 3).cast("int")), ",")
    doc = F.concat(F.lit('{"value":'), F.regexp_extract(value, r"^..x..(.*).$", 1), F.lit(',"tags":['), tags, F.lit('],"deep":{"a":{"b":{"c":{"d":{"e":1}}}}}}'))
    lines = spark.read.text(_text(spark, R.events(spark, d).select(doc.alias("value")), "json-lines"))
    return text.structure(lines.select(F.try_parse_json("value").alias("v")))


@query(f"SELECT * FROM {_JSON_SQL}")
def read_json_array(spark, d):
    """One array of all events, written in parts and put together, read in parallel."""
    items = _items(spark, d).select(F.concat("item", F.lit(",")).alias("value"))
    path = _one_file(spark, items, "[", '{"items": [1]}]', "array")
    rows = text.read_json(spark, path, split=True)
    return rows.filter("severity <> 'info'").select("ts_raw", "severity", "message", F.get_json_object(F.col("data")["item"], "$.seq").cast("long").alias("seq"), "parser")


def _one_file(spark: SparkSession, lines: DataFrame, head: str, tail: str, name: str) -> str:
    """Lines as one file between two others."""
    path, out = staging.folder(spark, name), spark.createDataFrame([(head,)], "value string")
    out.unionByName(lines.select("value")).unionByName(spark.createDataFrame([(tail,)], "value string")).coalesce(1).write.text(path)
    return path


@query("""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_raw, CAST(seq AS BIGINT) AS seq, 'line one of ' || event_type || chr(10) || 'said "x"; line two' || chr(10) || chr(10) || '.' AS note, 'csv' AS parser FROM """ + R.EVENTS_SQL)
def read_csv_multiline(spark, d):
    """Cells that hold line ends, quotes and the separator."""
    note = F.concat(F.lit("line one of "), "event_type", F.lit('\nsaid "x"; line two\n\n.'))
    rows = R.events(spark, d).select(F.col("seq").cast("string").alias("Record"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Event Time"), note.alias("Note"))
    path = staging.folder(spark, "csv-cells")
    rows.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    read = text.read_csv(spark, path, ";", True, multiline=True)
    return read.select("ts_raw", F.col("data")["Record"].cast("long").alias("seq"), F.col("data")["Note"].alias("note"), "parser")


# --- event XML ------------------------------------------------------------------------


def _event_xml(e: DataFrame) -> DataFrame:
    """One <Event> a line; data elements are named but for one, and one name stands twice."""
    cell = lambda name, value: F.concat(F.lit(f'<Data Name="{name}">'), F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</Data>"))
    return e.select(
        "seq",
        F.concat(
            F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="P'), (F.col("user_id") % 5).cast("string"), F.lit('"/><EventID>'), F.col("event_code").cast("string"), F.lit("</EventID><Level>"), (F.col("k") % 7).cast("string"),
            F.lit('</Level><TimeCreated SystemTime="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"/><Computer>srv'), (F.col("user_id") % 7).cast("string"), F.lit("</Computer></System><EventData>"),
            cell("Seq", F.lit("0")), cell("Seq", F.col("seq").cast("string")), cell("CommandLine", F.coalesce(F.col("data")["CommandLine"], F.lit("a < b & c"))), F.lit("<Data>bare</Data></EventData></Event>"),
        ).alias("value"),
    )


_LEVEL = "CASE k % 7 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 5 THEN 'low' ELSE 'info' END"
_XML_SQL = f"(SELECT seq, k, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS ts_raw, CAST(event_code AS INTEGER) AS event_code, {_LEVEL} AS severity, 'srv' || (user_id % 7) AS host, 'P' || (user_id % 5) AS provider, CASE WHEN event_type = 'view' THEN command_line ELSE 'a < b & c' END AS command_line, 'evtx' AS parser FROM {R.EVENTS_SQL})"


def _xml_columns(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("data")["Seq"].cast("long").alias("seq"), "ts_raw", "event_code", "severity", "host", "provider", F.col("data")["CommandLine"].alias("command_line"), F.size("data").alias("fields"), "parser")


@query(f"SELECT * EXCLUDE (k), CAST(2 AS INTEGER) AS fields FROM {_XML_SQL}")
def read_event_xml_file(spark, d):
    junk = spark.createDataFrame([("",), ("not xml",), ("<Event><EventData/></Event>",), ("<Event><System",)], "value string")
    path = _text(spark, _event_xml(R.events(spark, d)).select("value").union(junk), "event-xml")
    return _xml_columns(text.read_event_xml(spark, path))


@query(f"SELECT * EXCLUDE (k), CAST(2 AS INTEGER) AS fields FROM {_XML_SQL}")
def read_event_xml_pretty(spark, d):
    """The same records inside a root element, each over many lines."""
    pretty = F.replace("value", F.lit("><"), F.lit(">\n  <"))
    path = _one_file(spark, _event_xml(R.events(spark, d)).select(pretty.alias("value")), '<?xml version="1.0"?>\n<Events>', "</Events>", "event-xml")
    return _xml_columns(text.read_event_xml(spark, path))


@query(f"SELECT * EXCLUDE (k), CAST(2 AS INTEGER) AS fields FROM (SELECT * FROM (SELECT * FROM {_XML_SQL} ORDER BY seq LIMIT 250) WHERE event_code IN (4625, 7045) ORDER BY seq LIMIT 50)")
def read_event_xml_capped(spark, d):
    """Code filter and caps of the reader: so many events, of five times as many records looked at."""
    one = _event_xml(R.events(spark, d)).coalesce(1).sortWithinPartitions("seq")
    return _xml_columns(text.read_event_xml(spark, _text(spark, one, "event-xml"), codes="4625, 7045, x", max_records=50))


@query(f"SELECT * EXCLUDE (k), CAST(3 AS INTEGER) AS fields FROM (SELECT * FROM {_XML_SQL} ORDER BY seq LIMIT 50)")
def read_event_xml_legacy(spark, d):
    """The legacy form: fifty events, and unnamed data elements kept under a number."""
    one = _event_xml(R.events(spark, d)).coalesce(1).sortWithinPartitions("seq")
    return _xml_columns(text.read_event_xml(spark, _text(spark, one, "event-xml"), max_records=50, unnamed="data_"))


# --- mixed folders and inventory ------------------------------------------------------


@query(f"SELECT 'log' AS parser, severity, count(*) AS n FROM {_LOG_SQL} GROUP BY 2 UNION ALL SELECT 'json', severity, count(*) FROM {_JSON_SQL} GROUP BY 2 UNION ALL SELECT 'csv', CASE user_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'info' END, count(*) FROM events GROUP BY 2")
def read_mixed_folder(spark, d):
    """A folder of logs, CSV and JSON: each file by the reader of its extension."""
    root = staging.folder(spark, "evidence")
    _log_file(spark, d, f"{root}/logs")
    # As written: lines that are read and written again are dealt anew, which leaves files without a header, or with two.
    _csv_file(spark, d, f"{root}/tables")
    spark.read.text(_json_files(spark, d), wholetext=True).select(F.rtrim("value").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{root}/arrays")
    staging.rename(spark, f"{root}/arrays", ".txt", ".json")
    return dispatch.read_evidence(spark, root).groupBy("parser", "severity").agg(F.count("*").alias("n"))


def _nation_files(spark, d) -> str:
    """A file for each nation, its name and comment inside."""
    path = staging.folder(spark, "files")
    R.table(spark, d, "nation").select("n_nationkey", F.concat_ws(":", "n_name", F.col("n_regionkey").cast("string")).alias("value")).write.partitionBy("n_nationkey").text(path)
    return path


_FILE_SQL = "(SELECT n_name || ':' || n_regionkey || chr(10) AS content FROM nation)"


@query(f"SELECT 'Texte' AS type, CAST(octet_length(encode(content)) AS BIGINT) AS size_bytes, md5(content) AS md5, sha1(content) AS sha1, sha256(content) AS sha256 FROM {_FILE_SQL}")
def read_inventory(spark, d):
    return binary.inventory(spark, _nation_files(spark, d)).select("type", "size_bytes", "md5", "sha1", "sha256")


@query(f"SELECT count(*) AS files, CAST(sum(octet_length(encode(content))) AS BIGINT) AS size_bytes FROM {_FILE_SQL}")
def read_folder_size(spark, d):
    return stats.folder_size(binary.inventory(spark, _nation_files(spark, d)))


# --- binary evidence --------------------------------------------------------------------

_hex = lambda c: F.hex(F.encode(c, "UTF-16LE"))
_number = lambda n, size: F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)])


@query("SELECT n_name || '.EXE' AS executable, upper(lpad(hex(n_nationkey * 7 + 1), 8, '0')) AS hash, CAST(n_nationkey + 3 AS BIGINT) AS run_count FROM nation WHERE n_nationkey % 5 <> 4")
def read_prefetch(spark, d):
    """Prefetch files of two versions; some are compressed or no such file and are left out."""
    n, key = R.table(spark, d, "nation"), F.col("n_nationkey").cast("long")
    new = key % 2 == 1
    head = F.concat(F.when(new, _number(F.lit(26).cast("long"), 4)).otherwise(_number(F.lit(17).cast("long"), 4)), F.lit("53434341"), F.lit("00" * 8), F.rpad(_hex(F.concat("n_name", F.lit(".EXE"))), 120, "0"), _number(key * 7 + 1, 4))
    body = F.concat(F.rpad(head, 2 * 0x98, "0"), F.when(new, F.lit("")).otherwise(_number(key + 3, 4)))
    content = F.unhex(F.when(key % 10 == 4, F.lit("4D414D04" + "00" * 60)).when(key % 10 == 9, F.lit("00" * 90)).otherwise(F.when(new, F.concat(F.rpad(body, 2 * 0xD0, "0"), _number(key + 3, 4))).otherwise(body)))
    events = binary.prefetch_events(n.select("n_name", content.alias("content"), F.col("n_name").alias("path")))
    return events.select(F.col("process").alias("executable"), F.col("data")["hash"].alias("hash"), F.col("data")["run_count"].cast("long").alias("run_count"))


@query("SELECT 'C:\\tools\\' || n_name || '.exe' AS target_path, CASE WHEN n_nationkey % 3 = 0 THEN 'powershell -Enc x' ELSE '/run ' || n_nationkey END AS arguments, CASE WHEN n_nationkey % 3 = 0 THEN 'high' ELSE 'low' END AS severity FROM nation WHERE n_nationkey % 7 <> 6")
def read_shortcuts(spark, d):
    """Shortcuts with a path and arguments, some of them suspicious; others of a wrong class are left out."""
    n, key = R.table(spark, d, "nation"), F.col("n_nationkey").cast("long")
    string = lambda c: F.concat(_number(F.length(c).cast("long"), 2), _hex(c))
    target = F.concat(F.lit("C:\\tools\\"), "n_name", F.lit(".exe"))
    arguments = F.when(key % 3 == 0, F.lit("powershell -Enc x")).otherwise(F.concat(F.lit("/run "), key.cast("string")))
    clsid = F.when(key % 7 == 6, F.lit("00" * 16)).otherwise(F.lit(fixed.LNK_CLSID))
    content = F.unhex(F.concat(F.lit("4C000000"), clsid, F.lit("A8000000"), F.lit("00" * 52), string(target), string(arguments)))
    events = binary.shortcut_events(n.select(content.alias("content"), F.col("n_name").alias("path")))
    return events.select(F.col("data")["target_path"].alias("target_path"), F.col("data")["arguments"].alias("arguments"), "severity")


@query(f"SELECT event_type AS kind, CAST(3 - CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS cells, count(*) AS n FROM {R.EVENTS_SQL} GROUP BY 1, 2")
def read_tool_output(spark, d):
    """CSV files of an external tool: empty cells are left out."""
    e = R.events(spark, d)
    path = staging.folder(spark, "tool")
    rows = e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("TimeCreated"), F.col("event_type").alias("Kind"), F.when(F.col("k") % 2 == 0, F.col("user_id").cast("string")).alias("User"))
    rows.write.option("header", True).csv(path)
    read = text.read_tool_output(spark, path)
    return read.groupBy(F.col("data")["Kind"].alias("kind"), F.size("data").alias("cells")).agg(F.count("*").alias("n"))


@query("SELECT 'd_' || doc_id || '.log' AS original_filename, '20240102_030405_d_' || doc_id || '.log' AS filename, CAST(octet_length(encode(text)) AS BIGINT) AS file_size, md5(text) AS file_hash_md5, sha256(text) AS file_hash_sha256, 'log' AS file_type FROM documents WHERE doc_id % 2 = 0")
def artifact_ingest(spark, d):
    """Uploads: files of allowed kinds under unique names, with their digests."""
    docs, even = R.table(spark, d, "documents"), F.col("doc_id") % 2 == 0
    name = F.concat(F.when(even, F.lit("d ")).otherwise(F.lit("e")), F.col("doc_id").cast("string"), F.when(even, F.lit(".log")).otherwise(F.lit(".exe")))
    files = docs.select(F.concat(F.lit("/up/"), name).alias("path"), name.alias("name"), F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    rows = binary.ingest(files, "case", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    return rows.select(F.replace("original_filename", F.lit(" "), F.lit("_")).alias("original_filename"), "filename", "file_size", "file_hash_md5", "file_hash_sha256", "file_type")
