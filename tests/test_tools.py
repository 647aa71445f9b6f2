"""The tool registry, ingestion and tool outputs."""

from pyspark.sql import functions as F

from sleuthframe.operators import indicators
from sleuthframe.plans import tools
from sleuthframe.sources import binary, text

from .test_sources import EVENT, lnk_bytes, prefetch_bytes


def test_registry(spark, tmp_path):
    assert len(tools.TOOLS) >= 21 and tools.TOOLS["record_finding"].read_only is False
    (tmp_path / "e.xml").write_text("\n".join(EVENT.format(code=c) for c in [4625] * 6 + [1102]))
    (tmp_path / "a.pf").write_bytes(prefetch_bytes())
    (tmp_path / "l.lnk").write_bytes(lnk_bytes())
    root = str(tmp_path)
    call = lambda name, **kw: tools.call(spark, name, roots=[root], **kw)
    assert sorted(r["rule_id"] for r in call("sigma_scan", file_path=f"{root}/e.xml").collect()) == ["brute-force", "brute-force", "log-clearing"]
    assert [r["rule_id"] for r in call("sigma_scan", file_path=f"{root}/e.xml", tactic="defense_evasion").collect()] == ["log-clearing"]
    assert call("parse_prefetch", file_path=f"{root}/a.pf").first()["run_count"] == 7
    assert call("parse_lnk", file_path=f"{root}/l.lnk").first()["severity"] == "high"
    assert call("list_artifacts", case_dir=root).count() == 3
    assert call("parse_log_file", file_path="/etc/passwd").first()["error"] == "path outside the allowed folders"
    assert call("parse_log_file", file_path=f"{root}/../x").first()["error"] == "path outside the allowed folders"
    assert call("nonsense").first()["error"].startswith("unknown tool")
    assert tools.call(spark, "set_investigation_plan", read_only=True, case_id="c", steps=["a"]).first()["error"].startswith("not allowed")
    assert {r["value"] for r in tools.call(spark, "extract_iocs", text="8.8.8.8 evil.com").collect()} == {"8.8.8.8", "evil.com"}
    assert tools.call(spark, "mitre_map_events", event_ids=[4625, 1102]).count() == 2
    assert not tools.allowed("/data/case-10", ["/data/case-1"]) and tools.allowed("file:///data/case-1/x", ["/data/case-1"])


def test_case_memory(spark):
    findings = spark.createDataFrame([], "case_id string, seq long, title string, severity string, evidence string, mitre string, confidence string, verification string, verification_note string, id int")
    for title, severity in (("one", "critical"), ("two", "odd")):
        findings = tools.call(spark, "record_finding", findings=findings, case_id="c", title=title, severity=severity)
    findings = tools.call(spark, "verify_finding", findings=findings, case_id="c", finding_id=1, verdict="verified")
    assert [(r["id"], r["severity"], r["verification"]) for r in findings.orderBy("id").collect()] == [(1, "critical", "verified"), (2, "info", "pending")]
    plan = tools.call(spark, "complete_plan_step", plan=tools.call(spark, "set_investigation_plan", case_id="c", steps=["a", "b"]), step_index=1)
    none = spark.createDataFrame([], "case_id string, seq long, hypothesis string, status string, rationale string")
    one = tools.call(spark, "set_hypothesis", hypotheses=none, case_id="c", hypothesis="h", status="open")
    two = tools.call(spark, "set_hypothesis", hypotheses=one, case_id="c", hypothesis="h", status="confirmed")
    state = tools.call(spark, "get_case_state", findings=findings, hypotheses=two, plan=plan).first()
    assert (state["findings"], state["critical_or_high"], state["verified"], state["hypotheses_confirmed"], state["plan_remaining"]) == (2, 1, 1, 1, 1)
    assert "| 1 | critical |" in tools.call(spark, "save_report", case_id="c", title="T", markdown="body", findings=findings).first()["report"]


def test_ingest(spark, tmp_path):
    (tmp_path / "a b.log").write_text("x")
    (tmp_path / "no.exe").write_text("x")
    rows = binary.ingest(binary.read_files(spark, str(tmp_path)), "i", F.lit("2024-01-02 03:04:05").cast("timestamp")).collect()
    assert [(r["filename"], r["file_type"], r["file_size"]) for r in rows] == [("20240102_030405_a_b.log", "log", 1)]


def test_tool_output_and_csv_modes(spark, tmp_path):
    (tmp_path / "o.csv").write_text("﻿Time,Url,Host\n1,http://x.evil.com/a,b.evil.org\n2,,\n")
    rows = text.read_tool_output(spark, f"{tmp_path}/o.csv").orderBy("seq").collect()
    assert rows[0]["data"] == {"Time": "1", "Url": "http://x.evil.com/a", "Host": "b.evil.org"} and rows[1]["data"] == {"Time": "2"}
    events = text.read_csv(spark, f"{tmp_path}/o.csv", ",", True)
    urls = lambda mode: {r["value"] for r in indicators.of_events(events, mode).filter("type = 'url'").collect()}
    assert urls("cell") == {"http://x.evil.com/a"} and urls("joined") == {"http://x.evil.com/a,b.evil.org"}
