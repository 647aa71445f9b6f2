"""Registered queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators import attack, casestore, detect, export, indicators, stats, timeline, windows
from ..sources import staging
from . import frames as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def ioc_sql(table: str, key: str, text: str, types=None) -> str:
    """Distinct (key, type, value) of indicators, for DuckDB."""
    parts = []
    for kind, pattern, _ in fixed.IOC_PATTERNS:
        if types and kind not in types:
            continue
        value = {"ip": "v", "url": "v", "cve": "upper(v)"}.get(kind, "lower(v)")
        where = {"ip": f"WHERE NOT regexp_matches(v, '{fixed.PRIVATE_IP}')", "domain": "WHERE lower(v) NOT IN ('example.com', 'localhost.com')"}.get(kind, "")
        parts.append(f"SELECT {key}, '{kind}' AS type, {value} AS value FROM (SELECT {key}, unnest(regexp_extract_all({text}, '{_quoted(pattern)}')) AS v FROM {table}) {where}")
    return f"(SELECT DISTINCT {key}, type, value FROM ({' UNION ALL '.join(parts)}))"


def _iocs(df: DataFrame, text: str, *keys: str, types=None) -> DataFrame:
    return indicators.extract(df, text, keys, types).drop("source")


# --- indicators -----------------------------------------------------------------------


@query(f"SELECT type, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM {ioc_sql('pages', 'page_id', 'url')} UNION SELECT * FROM {ioc_sql('pages', 'page_id', 'html')}) GROUP BY type")
def ioc_pages_by_type(spark, d):
    pages = R.table(spark, d, "pages")
    texts = pages.select("page_id", F.explode(F.array("url", "html")).alias("text"))
    return _iocs(texts, "text", "page_id").groupBy("type").agg(F.count("*").alias("n"))


def _family(name: str, kind: str, table: str, key: str, text: str) -> None:
    def run(spark, d):
        return _iocs(R.table(spark, d, table), text, key, types=[kind])

    run.__name__ = name
    query(f"SELECT * FROM {ioc_sql(table, key, text, [kind])}")(run)


_family("ioc_ip_documents", "ip", "documents", "doc_id", "text")
_family("ioc_email_documents", "email", "documents", "doc_id", "text")
_family("ioc_domain_documents", "domain", "documents", "doc_id", "text")
_family("ioc_sha1_documents", "hash_sha1", "documents", "doc_id", "text")
_family("ioc_url_pages", "url", "pages", "page_id", "url")
_family("ioc_domain_pages", "domain", "pages", "page_id", "html")


@query(f"SELECT * FROM {ioc_sql(R.EVIDENCE_SQL, 'doc_id', 'line')}")
def ioc_all_families(spark, d):
    return _iocs(R.evidence_text(spark, d), "line", "doc_id")


@query(f"SELECT type, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'd' || doc_id AS k, type, value FROM {ioc_sql('documents', 'doc_id', 'text')} UNION ALL SELECT 'p' || page_id, type, value FROM {ioc_sql('pages', 'page_id', 'html')}) GROUP BY type")
def ioc_all_union_counts(spark, d):
    docs = R.table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("k"), "text")
    pages = R.table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("k"), F.col("html").alias("text"))
    return _iocs(docs.unionByName(pages), "text", "k").groupBy("type").agg(F.count("*").alias("n"))


@query(f"SELECT type, value, CAST(count(DISTINCT doc_id) AS BIGINT) AS sources FROM {ioc_sql('documents', 'doc_id', 'text')} GROUP BY type, value HAVING count(DISTINCT doc_id) >= 2")
def ioc_cross_artifact(spark, d):
    return indicators.across_sources(_iocs(R.table(spark, d, "documents"), "text", "doc_id"), "doc_id")


_STORED_SQL = f"(SELECT DISTINCT type, value FROM {ioc_sql(R.EVIDENCE_SQL, 'doc_id', 'line')} WHERE doc_id % 3 = 0)"


@query(f"SELECT type, value, min(doc_id) AS doc_id FROM {ioc_sql(R.EVIDENCE_SQL, 'doc_id', 'line')} i WHERE NOT EXISTS (SELECT 1 FROM {_STORED_SQL} s WHERE s.type = i.type AND s.value = i.value) GROUP BY type, value")
def ioc_insert_ignore(spark, d):
    found = _iocs(R.evidence_text(spark, d), "line", "doc_id")
    return indicators.insert_or_ignore(found, found.filter("doc_id % 3 = 0"), ["type", "value"], "doc_id").select("type", "value", "doc_id")


_IMPORT_SQL = f"(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'mutex' ELSE type END AS type, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE value END AS value FROM {ioc_sql(R.EVIDENCE_SQL, 'doc_id', 'line')})"


@query(f"""WITH r AS (SELECT *, CASE WHEN coalesce(type, '') = '' OR coalesce(trim(value), '') = '' THEN 'missing' WHEN type NOT IN {fixed.IOC_TYPES} THEN 'bad_type' ELSE 'valid' END AS outcome FROM {_IMPORT_SQL}),
f AS (SELECT DISTINCT type, value FROM r WHERE outcome = 'valid' AND NOT EXISTS (SELECT 1 FROM {_STORED_SQL} s WHERE s.type = r.type AND s.value = r.value)),
n AS (SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM r WHERE outcome <> 'valid' GROUP BY outcome UNION ALL SELECT 'imported', count(*) FROM f UNION ALL SELECT 'duplicate', (SELECT count(*) FROM r WHERE outcome = 'valid') - (SELECT count(*) FROM f))
SELECT outcome, CAST(n AS BIGINT) AS n FROM n WHERE n > 0""")
def ioc_import_accounting(spark, d):
    found = _iocs(R.evidence_text(spark, d), "line", "doc_id")
    rows = found.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 11 == 0, "mutex").otherwise(F.col("type")).alias("type"), F.when(F.col("doc_id") % 13 != 0, F.col("value")).alias("value"))
    return indicators.import_accounting(rows, found.filter("doc_id % 3 = 0").select("type", "value"), order="doc_id")


# --- log lines ------------------------------------------------------------------------


def _severity_sql(line: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({line}), '{'|'.join(w)}') THEN '{s}'" for s, w in fixed.SEVERITY_WORDS.items()) + " ELSE 'info' END"


@query(f"SELECT {_severity_sql('line')} AS severity, CAST(count(*) AS BIGINT) AS n FROM {R.LINES_SQL} GROUP BY 1")
def log_severity_histogram(spark, d):
    return R.log_lines(spark, d).groupBy(C.log_severity(F.col("line")).alias("severity")).agg(F.count("*").alias("n"))


@query(f"SELECT {_severity_sql('text')} AS severity, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def log_severity_documents(spark, d):
    return R.table(spark, d, "documents").groupBy(C.log_severity(F.col("text")).alias("severity")).agg(F.count("*").alias("n"))


@query("SELECT seq, " + ", ".join(f"regexp_extract(line, '{fixed.SYSLOG}', {i}) AS {n}" for i, n in ((1, "ts_text"), (2, "host"), (3, "process"), (5, "message"))) + f", nullif(regexp_extract(line, '{fixed.SYSLOG}', 4), '') AS pid FROM {R.LINES_SQL} WHERE regexp_matches(line, '{fixed.SYSLOG}')")
def log_syslog_fields(spark, d):
    return R.log_lines(spark, d).select("seq", C.syslog(F.col("line")).alias("s")).filter("s is not null").select("seq", F.col("s.ts").alias("ts_text"), "s.host", "s.process", "s.message", "s.pid")


@query("SELECT seq, coalesce(" + ", ".join(f"nullif(regexp_extract(line, '{p}', 1), '')" for p in fixed.TIMESTAMPS) + f", '') AS ts_text FROM {R.LINES_SQL}")
def log_timestamp_extract(spark, d):
    return R.log_lines(spark, d).select("seq", C.log_timestamp(F.col("line")).alias("ts_text"))


# --- event log ------------------------------------------------------------------------

_NAME_SQL = "CASE event_code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fixed.EVENT_NAMES.items()) + " ELSE '' END"


@query(f"SELECT event_code, CAST(count(*) AS BIGINT) AS n, {_NAME_SQL} AS description FROM {R.EVENTS_SQL} GROUP BY event_code ORDER BY n DESC, min(seq) LIMIT 20")
def evtx_event_counts_top20(spark, d):
    return stats.event_counts(R.events(spark, d))


@query(f"SELECT event_code, CAST(count(*) AS BIGINT) AS n FROM {R.EVENTS_SQL} WHERE event_code IN {fixed.SUSPICIOUS_EVENTS} GROUP BY event_code")
def evtx_suspicious(spark, d):
    return stats.suspicious_counts(R.events(spark, d))


@query(f"SELECT CASE k % 7 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 5 THEN 'low' ELSE 'info' END AS severity, CAST(count(*) AS BIGINT) AS n FROM {R.EVENTS_SQL} GROUP BY 1")
def evtx_level_severity(spark, d):
    return R.events(spark, d).groupBy(C.level_severity(F.col("k") % 7).alias("severity")).agg(F.count("*").alias("n"))


@query(f"SELECT seq, event_code FROM {R.EVENTS_SQL} WHERE event_code IN (4625, 7045)")
def evtx_filter_codes(spark, d):
    from ..sources.text import filter_codes

    return filter_codes(R.events(spark, d), "4625, 7045,x").select("seq", "event_code")


# --- ATT&CK ---------------------------------------------------------------------------

_EVENT_DIM = "(VALUES " + ", ".join(f"({k}, '{t}', '{i}', '{n}')" for k, t, i, n in fixed.EVENT_TO_ATTACK) + ") m(code, tactic, technique, technique_name)"
_IOC_DIM = "(VALUES " + ", ".join(f"('{k}', '{t}', '{i}', '{n}')" for k, t, i, n in fixed.IOC_TO_ATTACK) + ") m(kind, tactic, technique, technique_name)"


@query(f"SELECT seq, e.event_code, CAST(CASE WHEN m.code IS NULL THEN 0 ELSE 1 END AS BIGINT) AS techniques, coalesce(m.technique, '') AS technique FROM {R.EVENTS_SQL} e LEFT JOIN {_EVENT_DIM} ON e.event_code = m.code")
def attack_event_enrich(spark, d):
    out = attack.enrich_events(R.events(spark, d))
    return out.select("seq", "event_code", F.size("attack").cast("long").alias("techniques"), F.coalesce(F.get("attack", F.lit(0))["technique"], F.lit("")).alias("technique"))


@query(f"SELECT tactic, string_agg(label, '; ' ORDER BY f, label) AS techniques FROM (SELECT tactic, technique || ': ' || technique_name AS label, min(seq) AS f FROM {R.EVENTS_SQL} e JOIN {_EVENT_DIM} ON e.event_code = m.code GROUP BY 1, 2) GROUP BY tactic")
def attack_summary(spark, d):
    return attack.summary(R.events(spark, d)).select("tactic", F.array_join("techniques", "; ").alias("techniques"))


@query(f"SELECT tactic, technique, technique_name, CAST(count(*) AS BIGINT) AS indicators FROM {ioc_sql(R.EVIDENCE_SQL, 'doc_id', 'line')} i JOIN {_IOC_DIM} ON i.type = m.kind GROUP BY 1, 2, 3")
def attack_ioc_rollup(spark, d):
    return attack.ioc_rollup(_iocs(R.evidence_text(spark, d), "line", "doc_id"))


@query(f"SELECT tactic, CAST(count(*) AS BIGINT) AS indicators, CAST(count(DISTINCT technique) AS BIGINT) AS techniques FROM {ioc_sql(R.EVIDENCE_SQL, 'doc_id', 'line')} i JOIN {_IOC_DIM} ON i.type = m.kind GROUP BY tactic")
def attack_tactic_totals(spark, d):
    rolled = attack.ioc_rollup(_iocs(R.evidence_text(spark, d), "line", "doc_id"))
    return rolled.groupBy("tactic").agg(F.sum("indicators").alias("indicators"), F.count_distinct("technique").alias("techniques"))


# --- detection ------------------------------------------------------------------------


def _rule_sql(rule) -> str:
    """Alerts (rule_id, seq) of one rule over the rendered events."""
    have = {"image", "command_line", "logon_type", "service_name"}
    tests = [f"event_code IN ({', '.join(map(str, rule[4]))})"]
    for field, want in rule[5].items():
        tests.append(f"contains(lower({field}), '{want.lower()}')" if field in have else "FALSE")
    for field, want in rule[6].items():
        tests.append(f"TRY_CAST({field} AS BIGINT) = {want}" if field == "logon_type" else f"lower({field}) = '{want.lower()}'" if field in have else "FALSE")
    rows = f"SELECT '{rule[0]}' AS rule_id, '{rule[1]}' AS level, '{rule[2]}' AS tactic, '{rule[3]}' AS technique, seq, row_number() OVER (ORDER BY seq) AS nth FROM {R.EVENTS_SQL} WHERE {' AND '.join(tests)}"
    return f"SELECT rule_id, level, tactic, technique, seq FROM ({rows}) WHERE nth >= {rule[7]}"


def _rules_sql(keep=lambda r: True) -> str:
    return "(" + " UNION ALL ".join(_rule_sql(r) for r in fixed.RULES if keep(r)) + ")"


def _alerts(spark, d, **options) -> DataFrame:
    return detect.alerts(detect.normalise(R.events(spark, d)), detect.rules(spark, **options))


@query(f"SELECT rule_id, seq FROM {_rules_sql()}")
def rule_alerts(spark, d):
    return _alerts(spark, d).select("rule_id", "seq")


@query(f"SELECT rule_id, seq FROM {_rules_sql(lambda r: r[6])}")
def rule_match_equality(spark, d):
    return _alerts(spark, d, table=[r for r in fixed.RULES if r[6]]).select("rule_id", "seq")


@query(f"SELECT rule_id, seq FROM {_rules_sql(lambda r: r[5])}")
def rule_match_contains(spark, d):
    return _alerts(spark, d, table=[r for r in fixed.RULES if r[5]]).select("rule_id", "seq")


@query(f"""SELECT rule_id, seq FROM {_rules_sql(lambda r: r[7] == 1)} UNION ALL
    SELECT 'user-' || n, seq FROM {R.EVENTS_SQL} e, (SELECT unnest(range(20)) AS n) WHERE event_code = 1 AND event_type = 'view' AND contains(lower(command_line), lower(CASE n % 4 WHEN 0 THEN 'EncodedCommand' WHEN 1 THEN 'delete shadows' WHEN 2 THEN 'URLCACHE' ELSE 'no such word' END)) AND n % 3 <> 2
    UNION ALL SELECT 'logon-' || (k % 12), seq FROM {R.EVENTS_SQL} WHERE event_type = 'click'""")
def rule_match_many(spark, d):
    """The built-in rules among thousands that users have added: filed by one criterion each."""
    words = ("EncodedCommand", "delete shadows", "URLCACHE", "no such word")
    user = [(f"user-{n}", "high", "execution", "T1059", (1 if n % 3 < 2 else 77,), {"command_line": words[n % 4]}, {}, 1) for n in range(20)]
    user += [(f"logon-{n}", "low", "execution", "T1078", (4624,), {}, {"logon_type": f"0{n}"}, 1) for n in range(12)]
    user += [(f"other-{n}", "low", "execution", "T1059", (1, 4688), {"command_line": f"tool{n}.exe /run", "image": f"x{n}"}, {}, 1) for n in range(4_000)]
    plain = [r for r in fixed.RULES if r[7] == 1]
    return _alerts(spark, d, table=[*plain, *user]).select("rule_id", "seq")


@query(f"SELECT rule_id, seq FROM {_rules_sql(lambda r: r[7] > 1)}")
def rule_threshold_global(spark, d):
    return _alerts(spark, d, table=[r for r in fixed.RULES if r[7] > 1]).select("rule_id", "seq")


@query(f"SELECT user_id, seq FROM (SELECT user_id, seq, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS nth FROM {R.EVENTS_SQL} WHERE event_code = 4625) WHERE nth >= 5")
def rule_threshold_per_user(spark, d):
    found = detect.alerts(detect.normalise(R.events(spark, d)), detect.rules(spark, table=[fixed.RULES[0]]), scope=("user_id",))
    return found.select("user_id", "seq")


@query(f"SELECT rule_id, seq FROM {_rules_sql(lambda r: r[2] == 'persistence')}")
def rule_tactic_filter(spark, d):
    return _alerts(spark, d, tactic="persistence").select("rule_id", "seq")


@query(f"SELECT rule_id, level, tactic, technique, CAST(count(*) AS BIGINT) AS alerts FROM {_rules_sql()} GROUP BY 1, 2, 3, 4")
def rule_alert_counts(spark, d):
    return detect.alert_counts(_alerts(spark, d))


# --- counters -------------------------------------------------------------------------

_SLIDING_SQL = f"(SELECT seq, user_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) - (count(*) OVER (PARTITION BY user_id, us) - row_number() OVER (PARTITION BY user_id, us ORDER BY seq)) AS BIGINT) AS hits_in_window FROM (SELECT seq, user_id, epoch_us(ts) AS us FROM {R.EVENTS_SQL}))"


def _hits(spark, d):
    return R.events(spark, d).select("seq", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query(f"SELECT seq, user_id, hits_in_window FROM {_SLIDING_SQL}")
def rate_sliding_window(spark, d):
    return windows.sliding_hits(_hits(spark, d), "user_id", F.col("us"), 86400, "seq").select("seq", "user_id", "hits_in_window")


@query(f"SELECT seq, user_id, hits_in_window FROM {_SLIDING_SQL} WHERE hits_in_window > 4")
def rate_limited_hits(spark, d):
    return windows.rate_limited(_hits(spark, d), "user_id", F.col("us"), 86400, 4, "seq").select("seq", "user_id", "hits_in_window")


@query(f"""WITH RECURSIVE h AS (SELECT seq, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS r FROM {R.EVENTS_SQL}),
w AS (SELECT seq, user_id, us, r, us + 86400000000 AS until, CAST(1 AS BIGINT) AS counter FROM h WHERE r = 1
UNION ALL SELECT h.seq, h.user_id, h.us, h.r, CASE WHEN h.us >= w.until THEN h.us + 86400000000 ELSE w.until END, CASE WHEN h.us >= w.until THEN 1 ELSE w.counter + 1 END FROM w JOIN h ON h.user_id = w.user_id AND h.r = w.r + 1)
SELECT seq, user_id, counter FROM w""")
def ttl_fixed_window_counter(spark, d):
    return windows.fixed_window_hits(_hits(spark, d), "user_id", F.col("us"), 86400, "seq").select("seq", "user_id", "counter")


@query("SELECT CAST(b AS VARCHAR) AS le, CAST(count(*) FILTER (WHERE value <= b) AS BIGINT) AS n FROM events, (VALUES (1.0::DOUBLE), (5.0), (10.0), (50.0)) t(b) GROUP BY b UNION ALL SELECT '+Inf', count(value) FROM events")
def histogram_buckets(spark, d):
    return windows.cumulative_buckets(R.table(spark, d, "events"), "value", (1.0, 5.0, 10.0, 50.0))


# --- case memory ----------------------------------------------------------------------

_FINDINGS_SQL = "(SELECT CAST(l.doc_id % 10 AS VARCHAR) AS case_id, l.doc_id AS seq, CASE l.doc_id % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' ELSE 'urgent' END AS severity, CASE quality WHEN 1 THEN 'verified' ELSE CASE toxic WHEN 1 THEN 'refuted' ELSE 'unverified' END END AS verification FROM labels l)"


def _findings(spark, d):
    labels = R.table(spark, d, "labels")
    severity = F.element_at(F.array(*[F.lit(s) for s in (*fixed.SEVERITIES, "urgent")]), (F.col("doc_id") % 6 + 1).cast("int"))
    verification = F.when(F.col("quality") == 1, "verified").when(F.col("toxic") == 1, "refuted").otherwise("unverified")
    return labels.select((F.col("doc_id") % 10).cast("string").alias("case_id"), F.col("doc_id").alias("seq"), severity.alias("severity"), F.lit("possible").alias("confidence"), F.concat(F.lit("t|"), F.col("doc_id").cast("string")).alias("title"), F.lit("line\nbreak").alias("evidence"), F.lit("").alias("mitre"), verification.alias("verification"))


_CHECKED = f"CASE WHEN severity IN {fixed.SEVERITIES} THEN severity ELSE 'info' END"


@query(f"SELECT case_id, seq, CAST(row_number() OVER (PARTITION BY case_id ORDER BY seq) AS INTEGER) AS id, {_CHECKED} AS severity FROM {_FINDINGS_SQL}")
def finding_ids(spark, d):
    return casestore.clean_findings(_findings(spark, d), "seq").select("case_id", "seq", "id", "severity")


@query(f"SELECT case_id, count(*) AS findings, count(*) FILTER (WHERE {_CHECKED} IN ('critical', 'high')) AS critical_or_high, count(*) FILTER (WHERE verification = 'verified') AS verified, count(*) FILTER (WHERE verification IN ('unverified', 'refuted')) AS unverified, CAST(0 AS BIGINT) AS hypotheses_confirmed, CAST(1 AS BIGINT) AS hypotheses_open, CAST(2 AS BIGINT) AS plan_remaining FROM {_FINDINGS_SQL} GROUP BY case_id")
def findings_summary(spark, d):
    cases = spark.range(10).select(F.col("id").cast("string").alias("case_id"))
    plan = cases.select("case_id", F.explode(F.array(F.lit("done"), F.lit("todo"), F.lit("todo"))).alias("status"))
    return casestore.findings_summary(casestore.clean_findings(_findings(spark, d), "seq"), cases.withColumn("status", F.lit("open")), plan)


@query(f"SELECT seq, {_CHECKED} AS severity, CAST(CASE {_CHECKED} WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END AS BIGINT) AS rank FROM {_FINDINGS_SQL}")
def findings_severity_order(spark, d):
    f = casestore.clean_findings(_findings(spark, d), "seq")
    return f.select("seq", "severity", C.severity_rank(F.col("severity")).alias("rank")).orderBy("rank", "seq")


@query(f"""SELECT case_id, '## Constats (findings)' || chr(10) || chr(10) || '| # | Severite | Confiance | Verification | Constat | MITRE | Preuve |' || chr(10) || '|---|---|---|---|---|---|---|' || chr(10) ||
string_agg('| ' || id || ' | ' || severity || ' | possible | ' || CASE verification WHEN 'verified' THEN 'verifie' WHEN 'refuted' THEN 'refute' ELSE 'non verifie' END || ' | t\\|' || seq || ' | - | line break |', chr(10) ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END, id) || chr(10) AS markdown
FROM (SELECT case_id, seq, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS id, {_CHECKED} AS severity, verification FROM {_FINDINGS_SQL}) GROUP BY case_id""")
def findings_markdown(spark, d):
    return export.findings_markdown(casestore.clean_findings(_findings(spark, d), "seq"))


@query("SELECT user_id, event_type AS status, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def hypothesis_last_write(spark, d):
    rows = R.table(spark, d, "events").select("user_id", F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    return windows.last_write(rows, ["user_id"], "seq")


@query("SELECT role || ':' || CAST(conv_id % 50 AS VARCHAR) AS signature, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY 1 HAVING count(*) >= 3")
def tool_call_loops(spark, d):
    calls = R.table(spark, d, "conversations").select(F.concat("role", F.lit(":"), (F.col("conv_id") % 50).cast("string")).alias("signature"))
    return stats.loops(calls)


# --- case store -----------------------------------------------------------------------


@query(f"SELECT id, name, status FROM {R.INVESTIGATIONS_SQL} WHERE name ILIKE '%00_1%' OR description ILIKE '%00_1%' OR description ILIKE '%mach%'")
def investigations_search(spark, d):
    inv = R.investigations(spark, d)
    a, b = casestore.search(inv, "00_1"), casestore.search(inv, "mach", ("description",))
    return a.union(b).distinct().select("id", "name", "status")


@query(f"SELECT id, status FROM {R.INVESTIGATIONS_SQL} WHERE status = 'closed'")
def investigations_status(spark, d):
    found = casestore.search(R.investigations(spark, d), equal={"status": ("closed", fixed.STATUSES)})
    return casestore.search(found, equal={"status": ("nonsense", fixed.STATUSES)}).select("id", "status")


@query(f"SELECT id, name FROM {R.INVESTIGATIONS_SQL} ORDER BY number DESC LIMIT 200 OFFSET 200")
def investigations_page(spark, d):
    return casestore.page(R.investigations(spark, d), 2, 5000, [F.desc("number")]).select("id", "name")


@query(f"SELECT id, name FROM {R.INVESTIGATIONS_SQL} ORDER BY number DESC LIMIT 100 OFFSET 1000")
def investigations_deep_page(spark, d):
    """A page far behind the first, from the index of ranges."""
    index = casestore.PageIndex.build(R.investigations(spark, d), staging.folder(spark, "pages"), [F.desc("number")])
    return index.page(11, 100).select("id", "name")


@query(f"SELECT id, name FROM {R.INVESTIGATIONS_SQL} WHERE number < (SELECT max(number) FROM {R.INVESTIGATIONS_SQL}) - 50 ORDER BY number DESC LIMIT 200")
def investigations_next_page(spark, d):
    """The page after a row that the caller has seen."""
    rows = R.investigations(spark, d)
    last = rows.agg(F.max("number") - 50).first()[0]
    return casestore.page_after(rows, {"number": last}, {"number": False}, 200).select("id", "name")


@query(f"""SELECT id, investigation_id, filename, file_size FROM (SELECT id, investigation_id, CASE WHEN id % 10 = 0 THEN 'renamed' ELSE filename END AS filename, file_size FROM {R.ARTIFACTS_SQL}
    UNION ALL SELECT -id - 1, investigation_id, 'copy', file_size FROM {R.ARTIFACTS_SQL} WHERE id % 7 = 0) WHERE CAST(investigation_id AS BIGINT) % 5 <> 0""")
def case_store_changes(spark, d):
    """Artifacts written, appended to, renamed by upsert, and gone with their deleted investigations."""
    store = casestore.CaseStore(spark, staging.folder(spark, "cases"), slots=8)
    art = R.artifacts(spark, d)
    store.append("investigations", R.investigations(spark, d).select("id", "name", "status"))
    store.append("artifacts", art)
    store.append("artifacts", art.filter("id % 7 = 0").select((-F.col("id") - 1).alias("id"), "investigation_id", F.lit("copy").alias("filename"), "file_size"))
    store.upsert("artifacts", art.filter("id % 10 = 0").select("id", F.lit("renamed").alias("filename")))
    gone = art.select("investigation_id").distinct().filter("cast(investigation_id as long) % 5 = 0")
    store.delete([r[0] for r in gone.collect()])
    store.compact("artifacts", 2)
    return store.read("artifacts").select("id", "investigation_id", "filename", "file_size")


@query(f"SELECT i.id, coalesce(a.n, 0) AS artifact_count, coalesce(t.n, 0) AS large_count FROM {R.INVESTIGATIONS_SQL} i LEFT JOIN (SELECT investigation_id, count(*) AS n FROM {R.ARTIFACTS_SQL} GROUP BY 1) a ON i.id = a.investigation_id LEFT JOIN (SELECT investigation_id, count(*) AS n FROM {R.ARTIFACTS_SQL} WHERE file_size > 200000 GROUP BY 1) t ON i.id = t.investigation_id")
def investigations_with_counts(spark, d):
    art = R.artifacts(spark, d)
    return casestore.with_child_counts(R.investigations(spark, d).select("id"), {"artifact_count": (art, "investigation_id"), "large_count": (art.filter("file_size > 200000"), "investigation_id")})


@query(f"SELECT i.id, CAST(count(a.id) AS INTEGER) AS n, coalesce(string_agg(a.filename, ',' ORDER BY a.uploaded_at, a.id), '') AS files FROM {R.INVESTIGATIONS_SQL} i LEFT JOIN {R.ARTIFACTS_SQL} a ON i.id = a.investigation_id GROUP BY i.id")
def investigation_detail(spark, d):
    nested = casestore.detail(R.investigations(spark, d).select("id"), {"artifacts": (R.artifacts(spark, d), "investigation_id", ["uploaded_at", "id"])})
    return nested.select("id", F.coalesce(F.size("artifacts"), F.lit(0)).alias("n"), F.coalesce(F.array_join(F.transform("artifacts", lambda a: a["filename"]), ","), F.lit("")).alias("files"))


@query("SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS upload FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' AND l_linenumber > 1 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_totalprice > 150000)")
def orphan_uploads(spark, d):
    files = R.table(spark, d, "lineitem").filter("l_linenumber > 1").select(F.concat(F.col("l_orderkey").cast("string"), F.lit(".log")).alias("name"), F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("upload"), F.col("l_shipdate").alias("modified_at"))
    kept = R.table(spark, d, "orders").filter("o_totalprice > 150000").select(F.lit(None).cast("string").alias("filename"), F.concat(F.lit("/up/x/"), F.col("o_orderkey").cast("string"), F.lit(".log")).alias("file_path"))
    return casestore.orphans(files, kept, F.lit("1997-01-01").cast("timestamp_ntz")).select("upload")


@query(f"SELECT id, investigation_id FROM {R.ARTIFACTS_SQL} WHERE investigation_id NOT IN (SELECT id FROM {R.INVESTIGATIONS_SQL} WHERE status = 'archived')")
def cascade_delete(spark, d):
    gone = R.investigations(spark, d).filter("status = 'archived'").select(F.col("id").alias("gone"))
    return casestore.without(R.artifacts(spark, d), gone, "investigation_id").select("id", "investigation_id")


@query(f"SELECT id FROM {R.ARTIFACTS_SQL} WHERE investigation_id IN (SELECT id FROM {R.INVESTIGATIONS_SQL} WHERE status = 'active')")
def parent_exists(spark, d):
    live = R.investigations(spark, d).filter("status = 'active'").select(F.col("id").alias("parent"))
    return R.artifacts(spark, d).join(live, F.col("investigation_id") == F.col("parent"), "left_semi").select("id")


@query("SELECT coalesce(CAST(s.s_suppkey AS VARCHAR), CAST(c.c_custkey AS VARCHAR)) AS connector_id, coalesce(s.s_name, c.c_name) AS last_test_message, coalesce(CAST(s.s_nationkey AS BIGINT), CAST(c.c_nationkey AS BIGINT)) AS id FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey")
def config_upsert(spark, d):
    old = R.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("connector_id"), F.col("c_name").alias("last_test_message"), F.col("c_nationkey").cast("long").alias("id"))
    new = R.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("connector_id"), F.col("s_name").alias("last_test_message"), F.col("s_nationkey").cast("long").alias("id"))
    return casestore.upsert(old, new, ["connector_id"])


# --- dashboards -----------------------------------------------------------------------


@query(f"SELECT count(*) AS investigations, count(*) FILTER (WHERE status = 'active') AS investigations_active, count(*) FILTER (WHERE status = 'closed') AS investigations_closed, count(*) FILTER (WHERE status = 'archived') AS investigations_archived, (SELECT count(*) FROM orders) AS artifacts, (SELECT count(*) FROM events) AS timeline_events FROM {R.INVESTIGATIONS_SQL}")
def stats_overview(spark, d):
    return stats.overview(R.investigations(spark, d), {"artifacts": R.artifacts(spark, d), "timeline_events": R.table(spark, d, "events")})


@query(f"SELECT type, CAST(count(*) AS BIGINT) AS count FROM {ioc_sql(R.EVIDENCE_SQL, 'doc_id', 'line')} GROUP BY type")
def stats_by_type(spark, d):
    return indicators.counts_by(_iocs(R.evidence_text(spark, d), "line", "doc_id"), "type")


@query(f"SELECT {_severity_sql('line')} AS severity, CAST(count(*) AS BIGINT) AS count FROM {R.LINES_SQL} GROUP BY 1")
def stats_by_severity(spark, d):
    return indicators.counts_by(R.log_lines(spark, d).withColumn("severity", C.log_severity(F.col("line"))), "severity")


_LAST = "(SELECT max(CAST(ts AS DATE)) FROM events)"


def _last_day(spark, d):
    return R.table(spark, d, "events").agg(F.to_date(F.max("ts")).alias("last_day"))


def _daily(spark, d, kind):
    return stats.daily(R.table(spark, d, "events").filter(F.col("event_type") == kind), "ts", _last_day(spark, d).scalar())


@query(f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events WHERE event_type = 'error' AND CAST(ts AS DATE) > {_LAST} - 7 GROUP BY 1")
def stats_daily_7d(spark, d):
    return _daily(spark, d, "error").select(F.col("day").cast("string").alias("day"), "n")


@query(f"SELECT CAST(CAST(g.day AS DATE) AS VARCHAR) AS day, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'signup' AND user_id < 3) AS rare FROM (SELECT unnest(generate_series({_LAST} - 6, {_LAST}, INTERVAL 1 DAY)) AS day) g LEFT JOIN events ON CAST(ts AS DATE) = CAST(g.day AS DATE) GROUP BY 1")
def stats_dense_series(spark, d):
    last = _last_day(spark, d)
    rare = stats.daily(R.table(spark, d, "events").filter("event_type = 'signup' and user_id < 3"), "ts", last.scalar())
    return stats.dense_series(last, {"errors": _daily(spark, d, "error"), "rare": rare}).select(F.col("day").cast("string").alias("day"), "errors", "rare")


_HOST_SQL = "nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"


@query(f"SELECT {_HOST_SQL} AS host, CAST(count(*) AS BIGINT) AS visits FROM pages WHERE {_HOST_SQL} IS NOT NULL GROUP BY 1 ORDER BY visits DESC, host LIMIT 10")
def browser_top_hosts(spark, d):
    return stats.top_hosts(R.table(spark, d, "pages"))


@query("SELECT page_id, url FROM pages ORDER BY page_id DESC LIMIT 2000")
def browser_recent_visits(spark, d):
    return R.table(spark, d, "pages").select("page_id", "url").orderBy(F.desc("page_id")).limit(2000)


# --- artifacts ------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def artifact_hashes(spark, d):
    return R.table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query("SELECT sha256(text) AS sha256, CAST(count(*) AS BIGINT) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def artifact_duplicates(spark, d):
    return R.table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


_EXTS = (".evtx", ".PF", ".tar.gz", "", ".lnk", ".docx")


@query("SELECT name, CASE doc_id % 6 WHEN 0 THEN 'Journal Windows EVTX' WHEN 1 THEN 'Prefetch Windows' WHEN 2 THEN 'Inconnu (.gz)' WHEN 3 THEN 'Inconnu (sans extension)' WHEN 4 THEN 'Raccourci Windows LNK' ELSE 'Inconnu (.docx)' END AS type, n_chars AS size_bytes FROM (SELECT *, 'd' || doc_id || " + "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_EXTS)) + " END AS name FROM documents)")
def artifact_inventory(spark, d):
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTS]), (F.col("doc_id") % 6 + 1).cast("int"))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), ext)
    return R.table(spark, d, "documents").select(name.alias("name"), F.col("n_chars").alias("size_bytes")).select("name", C.file_type(F.col("name")).alias("type"), "size_bytes")


# --- timeline -------------------------------------------------------------------------

_TIMELINE_SQL = f"(SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_raw, event_type AS event, {_severity_sql('event_type')} AS severity, 'log' AS source FROM {R.EVENTS_SQL} UNION ALL SELECT strftime(uploaded_at, '%Y-%m-%d %H:%M:%S'), filename, 'info', 'artifact' FROM {R.ARTIFACTS_SQL})"


def _timeline(spark, d):
    e = R.events(spark, d).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts_raw"), F.col("event_type").alias("event"), C.log_severity(F.col("event_type")).alias("severity"))
    a = R.artifacts(spark, d).select(F.date_format("uploaded_at", "yyyy-MM-dd HH:mm:ss").alias("ts_raw"), F.col("filename").alias("event"), F.lit("info").alias("severity"))
    return timeline.merge({"log": e, "artifact": a})


@query(f"SELECT source, severity, count(*) AS n, min(ts_raw) AS first_ts, max(ts_raw) AS last_ts FROM {_TIMELINE_SQL} GROUP BY 1, 2")
def timeline_merge(spark, d):
    return _timeline(spark, d).groupBy("source", "severity").agg(F.count("*").alias("n"), F.min("ts_raw").alias("first_ts"), F.max("ts_raw").alias("last_ts"))


@query(f"SELECT ts_raw, event, severity, source FROM {_TIMELINE_SQL} WHERE severity = 'high'")
def timeline_filter(spark, d):
    return _timeline(spark, d).filter("severity = 'high'")


@query(f"SELECT ts_raw, event, severity, source FROM {_TIMELINE_SQL} ORDER BY ts_raw, source, event LIMIT 50 OFFSET 100")
def timeline_page(spark, d):
    return casestore.page(_timeline(spark, d), 3, 50, [F.coalesce("ts_raw", F.lit("")), "source", "event"])


@query(f"SELECT a.seq AS left_seq, b.seq AS right_seq FROM {R.EVENTS_SQL} a JOIN {R.EVENTS_SQL} b ON a.user_id = b.user_id AND a.event_code = 4625 AND b.event_code = 4624 AND epoch_us(b.ts) >= epoch_us(a.ts) AND epoch_us(b.ts) < epoch_us(a.ts) + 3600000000")
def timeline_correlate(spark, d):
    e = R.events(spark, d).select("seq", "user_id", "event_code", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    pairs = timeline.correlate(e.filter("event_code = 4625"), e.filter("event_code = 4624"), "user_id", "us", 3_600_000_000)
    return pairs.select(F.col("left.seq").alias("left_seq"), F.col("right.seq").alias("right_seq"))


# --- jobs and usage -------------------------------------------------------------------


@query("SELECT count(*) AS jobs, count(*) FILTER (WHERE event_type = 'view') AS jobs_running FROM events")
def jobs_running(spark, d):
    jobs = R.table(spark, d, "events").select(F.when(F.col("event_type") == "view", "running").otherwise("completed").alias("status"))
    return stats.running_jobs(jobs)


@query("SELECT conv_id, count(*) AS calls, CAST(sum(CASE WHEN turn % 3 = 0 THEN 0 ELSE length(text) END) AS BIGINT) AS prompt_tokens, CAST(sum(turn) AS BIGINT) AS completion_tokens, CAST(sum(length(text) + turn) AS BIGINT) AS total_tokens FROM conversations GROUP BY conv_id")
def token_usage(spark, d):
    size = F.length("text")
    calls = R.table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") % 3 != 0, size).alias("prompt_tokens"), F.col("turn").alias("completion_tokens"), (size + F.col("turn")).alias("total_tokens"))
    return stats.token_usage(calls, "conv_id")


@query("SELECT 'x' || doc_id || '.log' AS name FROM documents WHERE doc_id % 2 = 1 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0")
def inbox_settled(spark, d):
    """Two scans of a drop folder: files that did not grow, were there before, and are not handled."""
    from ..streaming import live

    docs = R.table(spark, d, "documents")
    name = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("x"), F.col("doc_id").cast("string"), F.lit(".log"))).otherwise(F.concat(F.lit("."), F.col("doc_id").cast("string")))
    now = docs.select("doc_id", F.concat(F.lit("/inbox/"), name).alias("path"), F.col("n_chars").cast("long").alias("length"))
    before = now.select("path", F.when(F.col("doc_id") % 3 == 0, F.col("length") - 1).otherwise(F.col("length")).alias("length"))
    return live.settled(now, before, now.filter("doc_id % 5 = 0")).select(C.base_name(F.col("path")).alias("name"))


# --- exports --------------------------------------------------------------------------


def _case_iocs(spark, d):
    found = _iocs(R.evidence_text(spark, d), "line", "doc_id")
    severity = F.element_at(F.array(*[F.lit(s) for s in fixed.IOC_SEVERITIES]), (F.col("doc_id") % 6 + 1).cast("int"))
    return found.select(F.col("doc_id").cast("string").alias("investigation_id"), "type", "value", F.lit("auto-extract").alias("source"), severity.alias("severity"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"))


_CASE_SQL = f"(SELECT CAST(doc_id AS VARCHAR) AS investigation_id, type, value, CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(fixed.IOC_SEVERITIES)) + f" END AS severity FROM {ioc_sql(R.EVIDENCE_SQL, 'doc_id', 'line')})"
_PATTERN_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN '[{_quoted(v)} = ''' || replace(value, '''', '\\''') || ''']'" for k, v in fixed.STIX_PATHS.items()) + " END"


@query(f"SELECT investigation_id, type || ': ' || value AS name, {_PATTERN_SQL} AS pattern, CASE WHEN severity = 'unknown' THEN '' ELSE 'severity:' || severity END AS labels FROM {_CASE_SQL}")
def stix_indicators(spark, d):
    return export.stix_indicators(_case_iocs(spark, d)).select("investigation_id", "name", "pattern", F.array_join("labels", ",").alias("labels"))


@query(f"SELECT severity, CAST(CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.CONFIDENCE_OF.items()) + f" ELSE 50 END AS INTEGER) AS confidence, CAST(count(*) AS BIGINT) AS n FROM {_CASE_SQL} GROUP BY 1, 2")
def stix_confidence(spark, d):
    return _case_iocs(spark, d).groupBy("severity", C.confidence(F.col("severity")).alias("confidence")).agg(F.count("*").alias("n"))


def _uuid5_sql(name: str) -> str:
    """Version-5 UUID of a name in the URL namespace, for DuckDB."""
    h = f"sha1(unhex('{fixed.NAMESPACE_URL}') || encode({name}))"
    variant = f"substr('89ab', 1 + (instr('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4, 1)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def _json_sql(**members: str) -> str:
    """Text of a JSON object of SQL values that are JSON already, for DuckDB."""
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in members.items()) + " || '}'"


def _text_sql(value: str) -> str:
    return f"CAST(to_json({value}) AS VARCHAR)"


_ME_SQL = f"'identity--' || {_uuid5_sql(f"'{export.PRODUCER}'")}"
_NOW_SQL, _MADE_SQL, _CHANGED_SQL = (f"'\"{t}\"'" for t in ("2024-02-01T00:00:00.000Z", "2024-01-01 00:00:00", "2024-01-02 00:00:00"))
_IDENTITY_SQL = _json_sql(type="'\"identity\"'", spec_version="'\"2.1\"'", id=_text_sql(_ME_SQL), created=_NOW_SQL, modified=_NOW_SQL, name=f"'\"{export.PRODUCER}\"'", identity_class="'\"system\"'")
_INDICATOR_SQL = f"(SELECT *, 'indicator--' || {_uuid5_sql("investigation_id || ':' || type || ':' || value")} AS ref, type || ': ' || value AS name, {_PATTERN_SQL} AS pattern, CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.CONFIDENCE_OF.items()) + f" ELSE 50 END AS confidence FROM {_CASE_SQL})"
_OBJECT_SQL = _json_sql(
    type="'\"indicator\"'",
    spec_version="'\"2.1\"'",
    id=_text_sql("ref"),
    created=_MADE_SQL,
    modified=_MADE_SQL,
    name=_text_sql("name"),
    description=_text_sql("'IoC detecte dans l''enquete case ' || investigation_id || '. Source: auto-extract'"),
    indicator_types="'[\"malicious-activity\"]'",
    pattern=_text_sql("pattern"),
    pattern_type="'\"stix\"'",
    valid_from=_MADE_SQL,
    confidence="confidence",
    created_by_ref=_text_sql(_ME_SQL) + " || CASE WHEN severity = 'unknown' THEN '' ELSE ',\"labels\":[\"severity:' || severity || '\"]' END",
)
_REPORT_SQL = _json_sql(
    type="'\"report\"'",
    spec_version="'\"2.1\"'",
    id=_text_sql("'report--' || id"),
    created=_MADE_SQL,
    modified=_CHANGED_SQL,
    name=_text_sql("'case ' || id"),
    description="'\"\"'",
    report_types="'[\"threat-report\"]'",
    published=_NOW_SQL,
    object_refs=f"'[' || {_text_sql(_ME_SQL)} || coalesce(refs, '') || ']'",
    created_by_ref=_text_sql(_ME_SQL),
)


@query(f"""SELECT id AS investigation_id, '{{"type":"bundle","id":"bundle--' || {_uuid5_sql("id")} || '","objects":[' || {_IDENTITY_SQL} || coalesce(objects, '') || ',' || {_REPORT_SQL} || ']}}' AS bundle
FROM (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents) LEFT JOIN (SELECT investigation_id, string_agg(',' || {_text_sql("ref")}, '' ORDER BY encode(name), ref) AS refs, string_agg(',' || {_OBJECT_SQL}, '' ORDER BY encode(name), ref) FILTER (WHERE pattern IS NOT NULL) AS objects FROM {_INDICATOR_SQL} GROUP BY 1) ON id = investigation_id""")
def stix_bundle(spark, d):
    inv = R.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("case "), F.col("doc_id").cast("string")).alias("name"), F.lit("").alias("description"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz").alias("updated_at"))
    return export.stix_bundles(inv, _case_iocs(spark, d), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


_MISP_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.MISP_TYPES.items()) + " END"


@query(f"SELECT {_MISP_SQL} AS misp_type, value, CASE WHEN type IN ('ip', 'domain', 'url') THEN 'Network activity' ELSE 'Payload delivery' END AS category, true AS to_ids, 'Source: auto-extract' AS comment FROM {_CASE_SQL}")
def misp_attributes(spark, d):
    return export.misp_attributes(_case_iocs(spark, d))


@query(f"SELECT type AS \"Type\", value AS \"Valeur\", 'auto-extract' AS \"Source\", severity AS \"Severite\", '2024-01-01 00:00:00' AS \"Date\" FROM {_CASE_SQL}")
def ioc_csv_export(spark, d):
    return export.ioc_csv(_case_iocs(spark, d).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")))


@query(f"""SELECT i.id AS investigation_id, '# Rapport d''Enquete: ' || name || chr(10) || chr(10) || 'Date: 2024-02-01 00:00:00' || chr(10) || 'Statut: ' || status || chr(10) || chr(10) || '## Artefacts (' || coalesce(a.n, 0) || ')' || coalesce(chr(10) || a.lines, '') || chr(10) || chr(10) || '## IoCs (' || coalesce(c.n, 0) || ')' || coalesce(chr(10) || c.lines, '') || chr(10) || chr(10) || '## Timeline (' || coalesce(t.n, 0) || ')' || coalesce(chr(10) || t.lines, '') AS report
FROM {R.INVESTIGATIONS_SQL} i LEFT JOIN (SELECT investigation_id, count(*) AS n, string_agg('- ' || filename || ' (SHA256: N/A)', chr(10) ORDER BY id) AS lines FROM {R.ARTIFACTS_SQL} GROUP BY 1) a ON i.id = a.investigation_id
LEFT JOIN (SELECT investigation_id, count(*) AS n, string_agg('- [' || type || '] ' || value || ' (source: auto-extract)', chr(10) ORDER BY type || '|' || value) AS lines FROM {_CASE_SQL} GROUP BY 1) c ON i.id = c.investigation_id
LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS investigation_id, count(*) AS n, string_agg('- ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || CASE WHEN k % 3 = 0 THEN 'high' ELSE 'info' END || '] ' || event_type, chr(10) ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S'), seq) AS lines FROM {R.EVENTS_SQL} GROUP BY 1) t ON i.id = t.investigation_id""")
def case_report(spark, d):
    art = R.artifacts(spark, d).select("id", "investigation_id", "filename", F.lit(None).cast("string").alias("original_filename"), F.lit(None).cast("string").alias("file_hash_sha256"))
    found = _case_iocs(spark, d).withColumn("id", F.concat_ws("|", "type", "value"))
    times = R.events(spark, d).select(F.col("seq").alias("id"), F.col("user_id").cast("string").alias("investigation_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.when(F.col("k") % 3 == 0, "high").alias("severity"), F.col("event_type").alias("event"))
    return export.case_report(R.investigations(spark, d), art, found, times, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@query("SELECT event_id, make_timestamp(13350000000000000 + event_id * 1000003 - 11644473600000000) AS visited_at FROM events")
def webkit_time(spark, d):
    return R.table(spark, d, "events").select("event_id", C.webkit_time(F.lit(13350000000000000) + F.col("event_id") * 1000003).cast("timestamp_ntz").alias("visited_at"))


@query("SELECT event_id, make_timestamp((133500000000000000 + event_id * 10000037) // 10 - 11644473600000000) AS written_at FROM events")
def filetime(spark, d):
    return R.table(spark, d, "events").select("event_id", C.filetime(F.lit(133500000000000000) + F.col("event_id") * 10000037).cast("timestamp_ntz").alias("written_at"))


@query("SELECT page_id, rtrim(translate(to_base64(encode(url)), '+/', '-_'), '=') AS url_id FROM pages")
def url_id_b64(spark, d):
    return R.table(spark, d, "pages").select("page_id", C.url_id(F.col("url")).alias("url_id"))


@query("SELECT p_partkey, CASE WHEN length(p_name) > 4 THEN '***' || right(p_name, 4) ELSE '***' END AS masked FROM part")
def secret_mask(spark, d):
    return R.table(spark, d, "part").select("p_partkey", C.mask_secret(F.col("p_name")).alias("masked"))


# --- further scalar functions, joins and filters ---------------------------------------


@query("SELECT DISTINCT CAST(event_code AS INTEGER) AS event_code FROM " + R.EVENTS_SQL)
def evtx_distinct_codes(spark, d):
    return R.events(spark, d).select("event_code").distinct().orderBy("event_code")


@query("SELECT event_id, split_part(line, ' ', 1) AS first_word, left(line, 30) AS cut FROM (SELECT event_id, trim(replace('  ' || event_type || ' of ' || user_id || repeat('x', 40), 'zz', '')) AS line FROM events)")
def sanitized_text(spark, d):
    line = F.concat(F.lit("  \x00"), "event_type", F.lit(" of "), F.col("user_id").cast("string"), F.repeat(F.lit("x"), 40))
    e = R.table(spark, d, "events").select("event_id", C.sanitize(line, 30).alias("cut"))
    return e.select("event_id", F.split("cut", " ")[0].alias("first_word"), "cut")


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '9.9.9.9' ELSE '10.1.0.' || (user_id % 200) END AS client FROM events")
def client_addresses(spark, d):
    e = R.table(spark, d, "events")
    forwarded = F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit(" 10.1.0."), (F.col("user_id") % 200).cast("string"), F.lit(" , 8.8.8.8")))
    return e.select("event_id", C.client_ip(forwarded, F.lit("9.9.9.9")).alias("client"))


@query("SELECT c_custkey, 'new' AS url, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE c_mktsegment END AS api_key, c_name AS note FROM customer")
def config_merge(spark, d):
    c = R.table(spark, d, "customer")
    old = F.create_map(F.lit("url"), F.lit("was"), F.lit("api_key"), F.lit("old"), F.lit("note"), F.col("c_name"))
    new = F.create_map(F.lit("url"), F.lit("new"), F.lit("api_key"), F.when(F.col("c_custkey") % 2 == 0, F.lit("***xold")).otherwise(F.col("c_mktsegment")), F.lit("note"), F.lit(""))
    merged = C.merge_config(old, new)
    return c.select("c_custkey", *[F.element_at(merged, F.lit(k)).alias(k) for k in ("url", "api_key", "note")])


@query("SELECT event_id, 'event_type=' || event_type || ', user_id=' || user_id AS rendered, CASE lower(event_type) WHEN 'error' THEN 'info' ELSE CASE user_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'info' END END AS severity FROM events")
def csv_rows(spark, d):
    e = R.table(spark, d, "events")
    raw = F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.element_at(F.array(F.lit("CRIT"), F.lit("Warning"), F.lit("high"), F.lit("notice")), (F.col("user_id") % 4 + 1).cast("int")))
    cells = F.create_map(F.lit("event_type"), "event_type", F.lit("user_id"), F.col("user_id").cast("string"))
    return e.select("event_id", C.key_values(cells).alias("rendered"), C.csv_severity(raw).alias("severity"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, 'info' AS severity FROM events")
def json_fields(spark, d):
    v = F.try_parse_json("props")
    return R.table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), F.coalesce(F.try_variant_get(v, "$.severity", "string"), F.lit("info")).alias("severity"))


@query("SELECT name, name NOT LIKE '.%' AND NOT ends_with(name, '.part') AND name <> 'LISEZMOI.txt' AS taken FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'LISEZMOI.txt' WHEN 1 THEN '.hidden' || doc_id WHEN 2 THEN 'x' || doc_id || '.part' ELSE 'x' || doc_id || '.log' END AS name FROM documents)")
def inbox_filter(spark, d):
    from ..streaming import live

    n = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 4 == 0, "LISEZMOI.txt").when(F.col("doc_id") % 4 == 1, F.concat(F.lit(".hidden"), n)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("x"), n, F.lit(".part"))).otherwise(F.concat(F.lit("x"), n, F.lit(".log")))
    return R.table(spark, d, "documents").select(name.alias("name")).withColumn("taken", ~live.inbox_ignored(F.col("name")))


@query(f"SELECT doc_id, value FROM {ioc_sql(R.EVIDENCE_SQL, 'doc_id', 'line', ['ip'])} WHERE value IN (SELECT '198.51.100.' || s_suppkey FROM supplier)")
def known_addresses(spark, d):
    known = R.table(spark, d, "supplier").select(F.concat(F.lit("198.51.100."), F.col("s_suppkey").cast("string")).alias("address"))
    return indicators.known_addresses(_iocs(R.evidence_text(spark, d), "line", "doc_id", types=["ip"]), "value", known).select("doc_id", "value")


@query(f"SELECT tactic, technique, CAST(count(*) AS BIGINT) AS n, min(value) AS first_value FROM {ioc_sql('pages', 'page_id', 'url')} i JOIN {_IOC_DIM} ON i.type = m.kind GROUP BY 1, 2")
def attack_ioc_matrix(spark, d):
    links = attack.ioc_links(_iocs(R.table(spark, d, "pages"), "url", "page_id"))
    return links.groupBy("tactic", "technique").agg(F.count("*").alias("n"), F.min("value").alias("first_value"))


_ANSWERS_SQL = f"(SELECT value, CAST(doc_id % 101 AS INTEGER) AS confidence_level, 'fam' || (doc_id % 3) AS malware FROM {ioc_sql(R.EVIDENCE_SQL, 'doc_id', 'line', ['ip'])})"


@query(f"SELECT DISTINCT i.value, a.confidence_level, a.families FROM {ioc_sql(R.EVIDENCE_SQL, 'doc_id', 'line', ['ip'])} i JOIN (SELECT value, max(confidence_level) AS confidence_level, string_agg(DISTINCT malware, ',' ORDER BY malware) AS families FROM {_ANSWERS_SQL} GROUP BY value) a ON i.value = a.value")
def connector_reductions(spark, d):
    from ..operators.connectors import REGISTRY

    found = _iocs(R.evidence_text(spark, d), "line", "doc_id", types=["ip"])
    answers = found.select("value", (F.col("doc_id") % 101).cast("int").alias("confidence_level"), F.lit("2024-01-01").alias("first_seen"), F.concat(F.lit("fam"), (F.col("doc_id") % 3).cast("string")).alias("malware"))
    out = REGISTRY["threatfox"].enrich(found.select("type", "value").distinct(), answers)
    return out.select("value", "confidence_level", F.array_join("families", ",").alias("families"))


@query("SELECT CASE p_size % 4 WHEN 0 THEN 'ip' WHEN 1 THEN 'registry_key' ELSE 'cve' END AS type, p_name AS value, 'misp' AS source FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 100) WHERE p_size % 4 <> 3")
def misp_pull(spark, d):
    from ..operators.connectors import pull_misp

    names = F.element_at(F.array(F.lit("ip-dst"), F.lit("regkey"), F.lit("vulnerability"), F.lit("yara")), (F.col("p_size") % 4 + 1).cast("int"))
    return pull_misp(R.table(spark, d, "part").select(F.col("p_partkey").alias("seq"), names.alias("type"), F.col("p_name").alias("value")), 100)


@query("SELECT CAST(c_custkey AS VARCHAR) AS connector_id, s_suppkey IS NOT NULL AND s_suppkey % 2 = 0 AS enabled, CASE WHEN s_suppkey IS NULL THEN '' WHEN length(s_name) > 4 THEN '***' || right(s_name, 4) ELSE '***' END AS api_key FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def connector_settings(spark, d):
    from ..operators.connectors import overlay_configs

    names = R.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("connector_id"))
    saved = R.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("connector_id"), (F.col("s_suppkey") % 2 == 0).alias("enabled"), F.create_map(F.lit("api_key"), "s_name").alias("config"))
    return overlay_configs(names, saved).select("connector_id", "enabled", F.coalesce(F.try_element_at("config", F.lit("api_key")), F.lit("")).alias("api_key"))


@query("SELECT 's' || c_custkey AS investigation_id, 'ip' AS type, c_name AS value, 'migration' AS source FROM customer UNION ALL SELECT 's' || c_custkey, 'domain', c_mktsegment, 'migration' FROM customer")
def migrated_sessions(spark, d):
    c = R.table(spark, d, "customer")
    iocs = F.create_map(F.lit("ips"), F.array(F.to_json(F.struct(F.col("c_name").alias("valeur")))), F.lit("domaines"), F.array("c_mktsegment"), F.lit("notes"), F.array(F.lit("x")))
    return casestore.migrate_sessions(c.select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("id"), iocs.alias("iocs")))


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active FROM {R.INVESTIGATIONS_SQL} WHERE name ILIKE '%1%'")
def investigations_total(spark, d):
    found = casestore.search(R.investigations(spark, d), "1", ("name",))
    return found.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"))


@query("SELECT event_id, 'GreyNoise: ' || c || CASE WHEN noise THEN ' (noise)' ELSE ' (targeted)' END AS message, CASE WHEN user_id >= 75 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT *, CASE user_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'benign' ELSE 'malicious' END AS c, user_id % 2 = 1 AS noise FROM events)")
def verdict_messages(spark, d):
    kind = F.when(F.col("user_id") % 3 == 1, "benign").when(F.col("user_id") % 3 == 2, "malicious")
    return R.table(spark, d, "events").select("event_id", C.greynoise_message(kind, F.col("user_id") % 2 == 1).alias("message"), C.threatfox_severity(F.col("user_id")).alias("severity"))


@query("SELECT DISTINCT l_orderkey, l_quantity FROM lineitem")
def files_by_name_and_size(spark, d):
    return R.table(spark, d, "lineitem").select("l_orderkey", "l_quantity").dropDuplicates(["l_orderkey", "l_quantity"])


# --- streams --------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream of one file."""
    batch = spark.read.parquet(f"{d}/events.parquet")
    raw = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.withColumn("at", F.col("ts").cast("timestamp"))


def _drained(spark: SparkSession, stream: DataFrame, name: str, complete: bool = False) -> DataFrame:
    """All rows that a stream gives for what is there now, written as Parquet by the tasks; in ``complete`` mode the last batch's."""
    path = staging.folder(spark, name)
    writer = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if complete:
        run = writer.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}/rows")).start()
    else:
        run = writer.outputMode("append").format("parquet").option("path", f"{path}/rows").start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("SELECT CAST(w AS VARCHAR) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS w FROM events) GROUP BY w, event_type")
def stream_sliding(spark, d):
    from ..streaming import live

    out = _drained(spark, live.windowed_counts(_stream(spark, d), "at", "event_type"), "sliding", complete=True)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS g FROM events)) GROUP BY 1, 2) GROUP BY user_id""")
def stream_sessions(spark, d):
    from ..streaming import live

    out = _drained(spark, live.session_counts(_stream(spark, d), "at", "user_id"), "sessions", complete=True)
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    from ..streaming import live

    once = live.deduplicated(_stream(spark, d).select("user_id", "event_type", "at"), "at", ["user_id", "event_type"], "40 days")
    return _drained(spark, once.select("user_id", "event_type"), "dedup")


@query(SQL["ttl_fixed_window_counter"].replace("SELECT seq, user_id, counter FROM w", "SELECT user_id, us AS at, counter FROM w"))
def stream_ttl_counter(spark, d):
    from ..streaming import live

    counted = live.ttl_counters(_stream(spark, d).select("user_id", "at"), "user_id", "at", 86400)
    return _drained(spark, counted.withColumnRenamed("key", "user_id"), "ttl")


@query(f"SELECT seq, user_id, hits_in_window FROM {_SLIDING_SQL}")
def stream_hits_per_window(spark, d):
    """The count of ``rate_sliding_window`` at each hit of a stream."""
    from ..streaming import live

    rows = _stream(spark, d).select(F.col("event_id").alias("seq"), "user_id", "at")
    with live.state_in_rocksdb(spark):
        out = _drained(spark, live.hits_per_window(rows, "user_id", "at", 86400, "seq"), "hits")
    return out.select(F.col("order").alias("seq"), F.col("key").alias("user_id"), "hits_in_window")


@query("SELECT 'r_regionkey=' || n_regionkey AS case_name, CAST(count(*) AS BIGINT) AS files, CAST(sum(octet_length(encode(n_name)) + 1) AS BIGINT) AS bytes, CAST(bit_xor(crc) AS BIGINT) AS content FROM (SELECT *, CAST('0x' || left(md5(n_name || chr(10)), 8) AS BIGINT) AS crc FROM nation) GROUP BY n_regionkey")
def stream_drop_folder(spark, d):
    """Nations as files dropped into a folder of each region; a partial copy beside them is left alone."""
    from ..streaming import live

    path = staging.folder(spark, "inbox")
    nations = R.table(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_name").alias("value"))
    nations.write.partitionBy("r_regionkey").option("maxRecordsPerFile", 1).text(path)
    nations.limit(3).select("value").write.text(f"{path}/copying.part")
    stream = live.drop_folder(spark, path, settle_seconds=0.2).filter("name <> '_SUCCESS'")
    out = _drained(spark, stream, "dropped")
    summed = F.bit_xor(F.conv(F.left(F.md5("content"), F.lit(8)), 16, 10).cast("long"))
    return out.groupBy("case_name").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), summed.alias("content"))


# --- further exports and checks ---------------------------------------------------------


@query("SELECT CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS number, 'Type invalide: ' || type AS error FROM (SELECT doc_id, 'kind' || (doc_id % 3) AS type FROM documents WHERE doc_id % 3 <> 0 ORDER BY doc_id LIMIT 10)")
def ioc_import_errors(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, F.lit("ip")).otherwise(F.concat(F.lit("kind"), (F.col("doc_id") % 3).cast("string")))
    rows = R.table(spark, d, "documents").select("doc_id", kind.alias("type"), F.lit("x").alias("value"))
    return indicators.import_errors(rows, ["doc_id"])


@query(f"""SELECT '# HELP events_total Events by type' AS line UNION ALL SELECT '# TYPE events_total counter' UNION ALL SELECT 'events_total{{event_type="' || event_type || '",odd="\\\\' || (user_id % 2) || '"}} ' || count(*) FROM events GROUP BY event_type, user_id % 2
    UNION ALL SELECT '# HELP investigations_active Active cases' UNION ALL SELECT '# TYPE investigations_active gauge' UNION ALL SELECT 'investigations_active ' || count(*) FROM {R.INVESTIGATIONS_SQL} WHERE status = 'active'""")
def prometheus_counters(spark, d):
    rows = R.events(spark, d).withColumn("odd", F.concat(F.lit("\\"), (F.col("user_id") % 2).cast("string")))
    counter = export.prometheus_counter(rows, "events_total", "Events by type", ["event_type", "odd"])
    active = R.investigations(spark, d).filter("status = 'active'")
    return counter.unionByName(export.prometheus_counter(active, "investigations_active", "Active cases", kind="gauge"))


@query("SELECT DISTINCT 'c' || (o_custkey % 50) AS investigation_id, CASE o_orderkey % 2 WHEN 0 THEN 'ip' ELSE 'domain' END AS type, 'v' || (o_orderkey % 400) || '\"' AS value FROM orders")
def session_documents(spark, d):
    """Indicators written as session documents and migrated back."""
    o = R.table(spark, d, "orders")
    rows = o.select(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("investigation_id"), F.when(F.col("o_orderkey") % 2 == 0, "ip").otherwise("domain").alias("type"), F.concat(F.lit("v"), (F.col("o_orderkey") % 400).cast("string"), F.lit('"')).alias("value"))
    written = export.session_json(rows)
    read = written.select("id", F.from_json("session", "iocs map<string,array<string>>")["iocs"].alias("iocs"))
    return casestore.migrate_sessions(read).select("investigation_id", "type", "value")


@query("""SELECT '{"seq":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS line FROM events""")
def json_log_lines(spark, d):
    return export.json_lines(R.events(spark, d).select("seq", "event_type", "user_id"))


@query("SELECT doc_id, doc_id % 3 = 0 AS valid FROM documents")
def uuid_checks(spark, d):
    """Identifiers of three forms, one of which is a UUID."""
    h = F.md5(F.col("doc_id").cast("string"))
    part = lambda a, n: F.substring(h, a, n)
    good = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    forms = F.when(F.col("doc_id") % 3 == 0, F.upper(good)).when(F.col("doc_id") % 3 == 1, h).otherwise(F.concat(good, F.lit("\n")))
    return R.table(spark, d, "documents").select("doc_id", C.is_uuid(forms).alias("valid"))
