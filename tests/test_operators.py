"""Detection, ATT&CK, case store, windows and exports on small fixtures."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from sleuthframe.operators import attack, casestore, connectors, detect, export, indicators, stats, windows


def events(spark, rows):
    return spark.createDataFrame([(i, c, d) for i, (c, d) in enumerate(rows)], "seq long, event_code int, data map<string,string>")


def rule_ids(spark, rows, **options):
    found = detect.alerts(detect.normalise(events(spark, rows)), detect.rules(spark, **options))
    return sorted(r["rule_id"] for r in found.collect())


@pytest.mark.parametrize(
    ("rows", "wanted"),
    [
        ([(1, {"CommandLine": "powershell -EncodedCommand AAAA"})], ["powershell-encoded"]),
        ([(1, {"CommandLine": "powershell -NoProfile -File script.ps1"})], []),
        ([(4624, {"LogonType": "10"}), (4624, {"LogonType": "2"})], ["rdp-success"]),
        ([(4624, {"LogonType": "9"})], ["pass-the-hash"]),
        ([(4625, {})] * 4, []),
        ([(4625, {})] * 5, ["brute-force"]),
        ([(4625, {})] * 6, ["brute-force"] * 2),
        ([(7045, {"ServiceName": "PSEXESVC"})], ["new-service", "psexec"]),
        ([(7045, {"ServiceName": "MyLegitService"})], ["new-service"]),
        ([(4769, {"TicketEncryptionType": "0X17"})], ["kerberoasting"]),
        ([(1, {"Image": "", "NewProcessName": "C:\\x\\MSHTA.exe"})], ["mshta-exec"]),
        ([(13, {"TargetObject": "HKLM\\Software\\CurrentVersion\\Run\\x"})], ["registry-runkey"]),
        ([(None, {}), (9999, {})], []),
    ],
)
def test_rules(spark, rows, wanted):
    assert rule_ids(spark, rows) == wanted


def test_rule_tactic(spark):
    assert rule_ids(spark, [(1102, {}), (7045, {})], tactic="persistence") == ["new-service"]


def test_rules_use_an_equi_join(spark):
    plan = detect.match(detect.normalise(events(spark, [(1, {})])), detect.rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_ten_thousand_rules_equal_the_plain_join(spark, monkeypatch):
    """Rules of every kind, filed by one criterion, against the broadcast join; in several automata too."""
    rng = random.Random(9)
    word = lambda: rng.choice(["Power", "shell", "SHADOWS", "ü-Tool", "a", "certutil", "no-such-word"]) + rng.choice(["", "", str(rng.randint(0, 3000))])
    table = []
    for i in range(10_000):
        contains = {f: word() for f in rng.sample(["command_line", "image", "service_name", "object_name"], rng.choice([0, 1, 1, 1, 2, 3]))}
        equals = {"logon_type": rng.choice(["3", "03", "x", "10"])} if rng.random() < 0.2 else {"ticket_encryption": "0X17"} if rng.random() < 0.1 else {}
        if not contains and not equals and rng.random() < 0.99:
            contains = {"image": ""}
        table.append((f"r{i}", "low", "t", "T1", tuple(rng.sample([1, 4624, 4688, 7045], rng.randint(1, 2))), contains, equals, 1))
    rows = [(rng.choice([1, 4624, 4688, 7045, None]), {"CommandLine": rng.choice(["powershell.exe -x", "vssadmin delete shadows", "Ü-TOOL a certutil12", ""]), "Image": rng.choice(["c:\\power77\\shell", None]), "ServiceName": "PowerService", "LogonType": rng.choice(["3", "10", "x"]), "TicketEncryptionType": "0x17"}) for _ in range(60)]
    log, rule_table = detect.normalise(events(spark, rows)), detect.rules(spark, table=table)
    pairs = lambda **k: sorted((r["rule_id"], r["seq"]) for r in detect.match(log, rule_table, **k).select("rule_id", "seq").collect())
    want = pairs(most=100_000)
    assert len(want) > 1_000 and pairs() == want
    plan = detect.match(log, rule_table)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    monkeypatch.setattr(detect, "WORDS", 700)
    assert pairs() == want


def test_attack(spark):
    out = {r["event_code"]: r["attack"] for r in attack.enrich_events(events(spark, [(4625, {}), (9999, {}), (None, {})])).collect()}
    assert [a["technique"] for a in out[4625]] == ["T1110"] and out[9999] == [] and out[None] is None
    summary = {r["tactic"]: r["techniques"] for r in attack.summary(events(spark, [(4625, {}), (1102, {}), (4688, {}), (4768, {})])).collect()}
    assert summary["Credential Access"] == ["T1110: Brute Force", "T1558.003: Kerberoasting"] and set(summary) == {"Credential Access", "Defense Evasion", "Execution"}


def test_insert_or_ignore_and_accounting(spark):
    rows = spark.createDataFrame([(1, "ip", "1.1.1.1"), (2, "ip", "1.1.1.1"), (3, "ip", "2.2.2.2"), (4, "mutex", "m"), (5, "", "x")], "seq long, type string, value string")
    have = spark.createDataFrame([("ip", "2.2.2.2")], "type string, value string")
    assert {r["outcome"]: r["n"] for r in indicators.import_accounting(rows, have).collect()} == {"imported": 1, "duplicate": 2, "bad_type": 1, "missing": 1}


def test_case_store(spark, tmp_path):
    store = casestore.CaseStore(spark, f"file://{tmp_path}")
    store.append("investigations", spark.createDataFrame([("a", "one", "active"), ("b", "two", "closed")], "id string, name string, status string"))
    rows = spark.createDataFrame([(1, "a", "ip", "1.1.1.1"), (2, "a", "ip", "1.1.1.1"), (3, "b", "ip", "1.1.1.1")], "id long, investigation_id string, type string, value string")
    assert store.insert_or_ignore("iocs", rows, "id") == 2
    assert store.insert_or_ignore("iocs", rows, "id") == 0
    store.upsert("investigations", spark.createDataFrame([("b", "archived"), ("c", "active")], "id string, status string"))
    assert {(r["id"], r["name"], r["status"]) for r in store.read("investigations").collect()} == {("a", "one", "active"), ("b", "two", "archived"), ("c", None, "active")}
    store.delete(["a"])
    assert [r["investigation_id"] for r in store.read("iocs").collect()] == ["b"]
    assert store.read("investigations").count() == 2


def folders(tmp_path, table):
    return {str(p.relative_to(tmp_path)) for p in (tmp_path / table / "data").glob("*/slot=*")}


def test_case_store_writes_only_slots_that_change(spark, tmp_path):
    store = casestore.CaseStore(spark, f"file://{tmp_path}", slots=16)
    cases = [f"case{i}" for i in range(60)]
    rows = spark.createDataFrame([(k, c, "ip", f"10.0.0.{k}") for k, c in enumerate(cases)], "id long, investigation_id string, type string, value string")
    store.append("iocs", rows)
    before, old = folders(tmp_path, "iocs"), store.read("iocs")
    one = spark.createDataFrame([(99, "case7", "ip", "1.2.3.4"), (98, "case7", "ip", "10.0.0.7")], rows.schema)
    assert store.insert_or_ignore("iocs", one, "id") == 1
    assert len(folders(tmp_path, "iocs") - before) == 1
    # A reader of the version before keeps it, and one case is read from one slot.
    assert old.count() == 60 and store.read("iocs").count() == 61 and store.read("iocs", version=1).count() == 60
    assert sorted(r["id"] for r in store.read("iocs", keys=["case7"]).collect()) == [7, 99]
    assert len({f.split("slot=")[1].split("/")[0] for f in store.read("iocs", keys=["case7"]).inputFiles()}) == 1
    was = folders(tmp_path, "iocs")
    store.upsert("iocs", spark.createDataFrame([("case7", "ip", "1.2.3.4", "high")], "investigation_id string, type string, value string, severity string"))
    assert len(folders(tmp_path, "iocs") - was) == 1
    assert {r["id"]: r["severity"] for r in store.read("iocs", keys=["case7"]).collect()} == {7: None, 99: "high"}
    was = folders(tmp_path, "iocs")
    store.delete(["case7"])
    assert len(folders(tmp_path, "iocs") - was) <= 1 and store.read("iocs").count() == 59


def test_case_store_compacts_and_expires(spark, tmp_path):
    store = casestore.CaseStore(spark, f"file://{tmp_path}", slots=4)
    for i in range(5):
        store.append("audit_log", spark.createDataFrame([(i * 10 + k, "x") for k in range(10)], "id long, action string"))
    assert max(len(f) for f in store.manifest("audit_log").values()) == 5 and store.compact("audit_log", 3) == 4
    assert all(len(f) == 1 for f in store.manifest("audit_log").values())
    assert sorted(r["id"] for r in store.read("audit_log").collect()) == list(range(50))
    assert store.expire("audit_log", 1) > 10 and len(folders(tmp_path, "audit_log")) == 4
    assert len(store.versions("audit_log")) == 1 and store.read("audit_log").count() == 50


def test_case_store_notices_another_writer(spark, tmp_path):
    one, two = (casestore.CaseStore(spark, f"file://{tmp_path}") for _ in range(2))
    rows = spark.createDataFrame([("a", "n")], "id string, name string")
    one.append("investigations", rows)
    there = two.versions("investigations")
    two.versions = lambda table: there[:-1]
    with pytest.raises(RuntimeError):
        two.append("investigations", rows)


def test_deep_pages_read_a_few_rows(spark, tmp_path):
    rows = spark.range(0, 400_000, 1, 4).select((F.col("id") * 7919 % 400_009).alias("k"), F.lit("x").alias("v"))
    index = casestore.PageIndex.build(rows, f"{tmp_path}/i", [F.desc("k")], row_group=1 << 14)
    want = [r["k"] for r in rows.orderBy(F.desc("k")).select("k").collect()]
    for number, size in ((1, 40), (10_000, 40), (2_001, 100), (1_999, 200), (2_000, 200), (2_001, 200)):
        assert [r["k"] for r in index.page(number, size).collect()] == want[(number - 1) * size : number * size]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        page = index.page(7_777, 40)
        page.collect()
        scan = page._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        assert scan.metrics().apply("numOutputRows").value() < 4_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_pages_after_a_row(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(100)], "a long, b long")
    order, last, seen = {"a": False, "b": True}, None, []
    while page := casestore.page_after(rows, last, order, 9).collect():
        seen += [(r["a"], r["b"]) for r in page]
        last = page[-1].asDict()
    assert seen == sorted(((i % 7, i) for i in range(100)), key=lambda x: (-x[0], x[1]))


def test_pages_are_clamped(spark):
    rows = spark.range(300)
    assert casestore.page(rows, 0, 1000, ["id"]).count() == 200
    assert [r[0] for r in casestore.page(rows, 2, 3, ["id"]).collect()] == [3, 4, 5]


def test_migrated_sessions(spark):
    old = spark.createDataFrame([("s", {"ips": ["1.1.1.1", '{"valeur": "2.2.2.2"}'], "domaines": ["x.com"], "other": ["y"]})], "id string, iocs map<string,array<string>>")
    assert {(r["type"], r["value"]) for r in casestore.migrate_sessions(old).collect()} == {("ip", "1.1.1.1"), ("ip", "2.2.2.2"), ("domain", "x.com")}


def test_sliding_window_equals_replay(spark):
    rng = random.Random(3)
    rows = sorted((rng.randint(0, 300) * 1_000_000, rng.randint(0, 3), i) for i in range(400))
    rows = [(i, k, t) for i, (t, k, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "seq long, k long, t long")
    got = {r["seq"]: r["hits_in_window"] for r in windows.sliding_hits(df, "k", F.col("t"), 60, "seq").collect()}
    seen: dict[int, list[int]] = {}
    for i, k, t in rows:
        hits = seen.setdefault(k, [])
        hits.append(t)
        assert got[i] == sum(t - h < 60_000_000 for h in hits)
    fixed = {r["seq"]: r["counter"] for r in windows.fixed_window_hits(df, "k", F.col("t"), 30, "seq").collect()}
    state: dict[int, tuple[int, int]] = {}
    for i, k, t in rows:
        until, n = state.get(k, (0, 0))
        until, n = (t + 30_000_000, 1) if n == 0 or t >= until else (until, n + 1)
        state[k] = until, n
        assert fixed[i] == n


def test_stix_bundle_is_json_with_python_uuids(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    inv = spark.createDataFrame([("i1", "case 'x'", None)], "id string, name string, description string").withColumns({"created_at": now, "updated_at": now})
    iocs = spark.createDataFrame([("i1", "ip", "1.1.1.1", "s", "high"), ("i1", "mutex", "m", None, None)], "investigation_id string, type string, value string, source string, severity string").withColumn("created_at", now)
    bundle = json.loads(export.stix_bundles(inv, iocs, now).first()["bundle"])
    kinds = [o["type"] for o in bundle["objects"]]
    assert kinds == ["identity", "indicator", "report"]
    assert bundle["id"] == f"bundle--{uuid.uuid5(uuid.NAMESPACE_URL, 'i1')}"
    assert bundle["objects"][1]["id"] == f"indicator--{uuid.uuid5(uuid.NAMESPACE_URL, 'i1:ip:1.1.1.1')}"
    assert bundle["objects"][1]["labels"] == ["severity:high"] and bundle["objects"][1]["confidence"] == 85
    assert len(bundle["objects"][2]["object_refs"]) == 3


def test_prometheus_histogram(spark):
    lines = [r["line"] for r in export.prometheus_histogram(spark.createDataFrame([(0.004,), (0.02,), (99.0,)], "v double"), "v", "h").collect()]
    assert 'h_bucket{le="0.005"} 1' in lines and 'h_bucket{le="0.025"} 2' in lines and 'h_bucket{le="+Inf"} 3' in lines and "h_count 3" in lines


def test_connectors(spark):
    iocs = spark.createDataFrame([("ip", "1.1.1.1"), ("url", "http://x"), ("cve", "CVE-1")], "type string, value string")
    vt = connectors.REGISTRY["virustotal"].enrich(iocs, spark.createDataFrame([("1.1.1.1", 3)], "value string, malicious int"))
    assert {r["value"]: r["malicious"] for r in vt.collect()} == {"1.1.1.1": 3, "http://x": 0}
    assert {r["vendor_type"] for r in connectors.vendor_type(iocs, "misp").collect()} == {"ip-dst", "url", "vulnerability"}
    feed = spark.createDataFrame([(1, "regkey", "k", 80), (2, "yara", "r", 80), (3, "md5", "m", 80)], "seq long, type string, value string, confidence_level int")
    assert [r["type"] for r in connectors.pull_misp(feed, 2).collect()] == ["registry_key"]
    assert len(connectors.REGISTRY) >= 11


def test_top_k_ties_by_first_sight(spark):
    rows = stats.event_counts(events(spark, [(3, {}), (1, {}), (1, {}), (3, {}), (7, {})]), 2).collect()
    assert [(r["event_code"], r["n"]) for r in rows] == [(3, 2), (1, 2)]


def test_counters_of_busy_keys(spark):
    """A busy key over many blocks, ties, times missing and before the epoch, held against plain loops."""
    rng = random.Random(7)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *range(-300, 900)])) for i in range(600)]
    df = spark.createDataFrame([(i, k, None if t is None else t * 1_000_000) for i, k, t in rows], "seq long, k string, t long")
    sliding, fixed = {}, {}
    for key in {k for _, k, _ in rows}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        until = n = None
        for i, _, t in mine:
            if t is None:
                sliding[i] = sum(u is None and j <= i for j, _, u in mine)
                fixed[i] = sliding[i]
                continue
            sliding[i] = sum(u is not None and t - 60 < u <= t and (u < t or j <= i) for j, _, u in mine)
            if until is None or t >= until:
                until, n = t + 60, 0
            n += 1
            fixed[i] = n
    assert {r["seq"]: r["hits_in_window"] for r in windows.sliding_hits(df, "k", F.col("t"), 60, "seq").collect()} == sliding
    assert {r["seq"]: r["counter"] for r in windows.fixed_window_hits(df, "k", F.col("t"), 60, "seq").collect()} == fixed


def test_running_number_in_blocks(spark):
    df = spark.createDataFrame([(i * 3 - 50, None if i % 7 == 0 else i % 2) for i in range(200)], "seq long, k int")
    want = {}
    for i in sorted(r["seq"] for r in df.collect()):
        key = None if (i + 50) // 3 % 7 == 0 else (i + 50) // 3 % 2
        want[i] = sum((j + 50) // 3 % 7 == 0 if key is None else (j + 50) // 3 % 7 != 0 and (j + 50) // 3 % 2 == key for j in range(-50, i + 1, 3))
    for block in (1, 10, 1 << 20):
        assert {r["seq"]: r["n"] for r in windows.running_number(df, ["k"], "seq", "n", block).collect()} == want
    by_text = windows.running_number(df.withColumn("seq", F.format_string("%05d", F.col("seq") + 50)), ["k"], "seq", "n")
    assert sorted(r["n"] for r in by_text.collect()) == sorted(want.values())
