"""A registry of named tools over evidence and cases: what an analyst's client may call.

Each takes (spark, **arguments) and returns a DataFrame.  Errors become one row with an
``error`` column; paths outside the allowed roots are refused before anything is read.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators import attack, casestore, detect, indicators, windows
from ..sources import binary, dispatch, text


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[..., DataFrame]
    read_only: bool = True
    paths: tuple[str, ...] = ()


TOOLS: dict[str, Tool] = {}


def tool(read_only: bool = True, paths: tuple[str, ...] = ()):
    def register(fn):
        TOOLS[fn.__name__] = Tool(fn.__name__, fn, read_only, paths)
        return fn

    return register


def allowed(path: str, roots: Sequence[str]) -> bool:
    """Whether a path is one of the roots or below one, after its dots are resolved."""
    plain = lambda p: posixpath.normpath(re.sub(r"^[a-zA-Z][\w+.-]*:(//[^/]*)?", "", p))
    target = plain(path)
    return any(target == (r := plain(root)) or target.startswith(r.rstrip("/") + "/") for root in roots)


def call(spark: SparkSession, name: str, roots: Sequence[str] | None = None, read_only: bool = False, **arguments) -> DataFrame:
    """Runs a tool; what goes wrong is a row (error)."""
    wrong = lambda message: spark.createDataFrame([(message,)], "error string")
    found = TOOLS.get(name)
    if found is None:
        return wrong(f"unknown tool: {name}")
    if read_only and not found.read_only:
        return wrong(f"not allowed: {name}")
    if roots is not None and not all(allowed(arguments[p], roots) for p in found.paths if p in arguments):
        return wrong("path outside the allowed folders")
    try:
        return found.run(spark, **arguments)
    except Exception as e:
        return wrong(str(e).splitlines()[0][:500])


@tool(paths=("case_dir",))
def list_artifacts(spark, case_dir):
    return binary.inventory(spark, case_dir)


@tool(paths=("file_path",))
def parse_evtx(spark, file_path, event_id_filter=None, max_records=None):
    if file_path.lower().endswith(".evtx"):
        return text.filter_codes(binary.read_evtx(binary.read_files(spark, file_path)), event_id_filter)
    return text.read_event_xml(spark, file_path, event_id_filter, max_records)


@tool(paths=("file_path",))
def parse_csv(spark, file_path, max_rows=None):
    return text.read_csv(spark, file_path, max_rows=max_rows)


@tool(paths=("file_path",))
def parse_json_file(spark, file_path):
    return text.read_json(spark, file_path)


@tool(paths=("file_path",))
def parse_log_file(spark, file_path, max_lines=None):
    return text.read_log(spark, file_path, max_lines)


@tool(paths=("file_path",))
def parse_prefetch(spark, file_path):
    return binary.prefetch(binary.read_files(spark, file_path))


@tool(paths=("file_path",))
def parse_lnk(spark, file_path):
    return binary.shortcuts(binary.read_files(spark, file_path))


@tool(paths=("file_path",))
def parse_browser_history(spark, file_path, limit=2000):
    return binary.browser_history(binary.read_files(spark, file_path), limit)


@tool(paths=("file_path",))
def analyze_artifact(spark, file_path):
    return dispatch.read_evidence(spark, file_path)


@tool(paths=("file_path",))
def extract_iocs(spark, text=None, file_path=None):
    """Indicators of a text, or of a file, which goes first."""
    source = spark.read.text(file_path, wholetext=True) if file_path else spark.createDataFrame([(text or "",)], "value string")
    return indicators.extract(source, "value")


@tool(paths=("file_path",))
def sigma_scan(spark, file_path, tactic=None):
    events = detect.normalise(parse_evtx(spark, file_path))
    return detect.alerts(events, detect.rules(spark, tactic=tactic)).select("rule_id", "level", "tactic", "technique", "event_code", "ts_raw", "seq")


@tool()
def mitre_map_events(spark, event_ids):
    rows = spark.createDataFrame([(i, int(c)) for i, c in enumerate(event_ids)], "seq long, event_code int")
    return attack.summary(rows)


@tool()
def virustotal_lookup(spark, ioc_type, value, answers):
    from ..operators.connectors import REGISTRY

    return REGISTRY["virustotal"].enrich(spark.createDataFrame([(ioc_type, value)], "type string, value string"), answers)


@tool(paths=("path",))
def read_tool_csv(spark, path, max_rows=200):
    return text.read_tool_output(spark, path, max_rows)


_PLAN = "case_id string, seq long, step string, status string, note string"
_FINDING = "case_id string, seq long, title string, severity string, evidence string, mitre string, confidence string, verification string, verification_note string"
_HYPOTHESIS = "case_id string, seq long, hypothesis string, status string, rationale string"


@tool(read_only=False)
def set_investigation_plan(spark, case_id, steps):
    return spark.createDataFrame([(case_id, i, s, "todo", "") for i, s in enumerate(steps, 1)], _PLAN)


@tool(read_only=False)
def complete_plan_step(spark, plan, step_index, note=""):
    hit = F.col("seq") == step_index
    return plan.withColumn("status", F.when(hit, "done").otherwise(F.col("status"))).withColumn("note", F.when(hit, F.lit(note)).otherwise(F.col("note")))


@tool(read_only=False)
def record_finding(spark, findings, case_id, title, severity="info", evidence="", mitre="", confidence="possible"):
    """The findings of a case with one more, which gets the next number."""
    last = findings.filter(F.col("case_id") == case_id).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    new = spark.createDataFrame([(case_id, last + 1, title, severity, evidence, mitre, confidence, "pending", "")], _FINDING)
    return casestore.clean_findings(findings.drop("id").unionByName(new), "seq")


@tool(read_only=False)
def set_hypothesis(spark, hypotheses, case_id, hypothesis, status="open", rationale=""):
    """Hypotheses with one set: the last word on the same text counts."""
    last = hypotheses.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    new = spark.createDataFrame([(case_id, last + 1, hypothesis, status, rationale)], _HYPOTHESIS)
    return windows.last_write(hypotheses.unionByName(new.withColumn("status", C.one_of(F.col("status"), fixed.HYPOTHESIS_STATUSES, "open"))), ["case_id", "hypothesis"], "seq")


@tool()
def get_case_state(spark, findings, hypotheses, plan):
    return casestore.findings_summary(findings, hypotheses, plan)


@tool(read_only=False)
def verify_finding(spark, findings, case_id, finding_id, verdict, note=""):
    hit = (F.col("case_id") == case_id) & (F.col("id") == finding_id)
    checked = C.one_of(F.lit(verdict), fixed.VERDICTS, "unverified")
    return findings.withColumn("verification", F.when(hit, checked).otherwise(F.col("verification"))).withColumn("verification_note", F.when(hit, F.left(F.lit(note), F.lit(1000))).otherwise(F.col("verification_note")))


@tool(read_only=False)
def save_report(spark, case_id, title, markdown, findings):
    """(case_id, report): a report with the table of findings behind it."""
    from ..operators.export import findings_markdown

    annex = findings_markdown(findings.filter(F.col("case_id") == case_id))
    base = spark.createDataFrame([(case_id, f"# {title}\n\n{markdown}\n")], "case_id string, body string")
    return base.join(annex, "case_id", "left").select("case_id", F.concat_ws("\n", "body", "markdown").alias("report"))
