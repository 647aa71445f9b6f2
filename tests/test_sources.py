"""Readers on synthetic evidence, and the watched folder."""

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from sleuthframe.operators import indicators
from sleuthframe.sources import binary, dispatch, text


def test_log(spark, tmp_path):
    (tmp_path / "auth.log").write_text("Jan  2 03:04:05 web sshd[7]: Failed password\n\n  plain 2024-01-02 03:04:05 CRITICAL  \nJan  2 03:04:06 web kernel: up\n")
    rows = text.read_log(spark, f"{tmp_path}/auth.log").orderBy("seq").collect()
    assert [(r["severity"], r["host"], r["pid"], r["ts_raw"]) for r in rows] == [("high", "web", "7", "Jan  2 03:04:05"), ("critical", None, None, "2024-01-02 03:04:05"), ("info", "web", None, "Jan  2 03:04:06")]
    assert rows[1]["data"] == {"raw": "plain 2024-01-02 03:04:05 CRITICAL"}
    assert text.read_log(spark, f"{tmp_path}/auth.log", max_lines=1).count() == 1


def test_csv(spark, tmp_path):
    (tmp_path / "fw.csv").write_text("Event_Time;Source;Level;x\n2024-01-01;8.8.8.8;WARN;1\n2024-01-02;1.1.1.1;error;2\n")
    rows = text.read_csv(spark, f"{tmp_path}/fw.csv").orderBy("seq").collect()
    assert [(r["ts_raw"], r["severity"]) for r in rows] == [("2024-01-01", "medium"), ("2024-01-02", "info")]
    assert rows[0]["message"] == "Event_Time=2024-01-01, Source=8.8.8.8, Level=WARN, x=1"
    found = indicators.extract(text.read_csv(spark, f"{tmp_path}/fw.csv").select(F.explode(F.map_values("data")).alias("cell")), "cell")
    assert {r["value"] for r in found.collect()} == {"8.8.8.8", "1.1.1.1"}


def test_csv_files_of_several_shapes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Event_Time;Level;x\n" + "2024-01-01;WARN;1\n" * 30 + "2024-01-02;error;2;9\n2024-01-03\n")
    (tmp_path / "b.csv").write_text('time,note\n1,"two\nlines, and a comma"\n')
    (tmp_path / "c.csv").write_text("1|2\n3|4\n5|6\n")
    rows = {(r["source_file"][-5:], r["seq"]): r for r in binary.csv_events(binary.read_files(spark, str(tmp_path), "*.csv")).collect()}
    assert [(rows["a.csv", i]["ts_raw"], rows["a.csv", i]["severity"]) for i in (0, 30, 31)] == [("2024-01-01", "medium"), ("2024-01-02", "info"), ("2024-01-03", "info")]
    assert rows["a.csv", 30]["data"] == {"Event_Time": "2024-01-02", "Level": "error", "x": "2"} and rows["a.csv", 31]["data"] == {"Event_Time": "2024-01-03"}
    assert rows["b.csv", 0]["data"]["note"] == "two\nlines, and a comma"
    assert rows["c.csv", 0]["data"] == {"col_0": "1", "col_1": "2"} and rows["c.csv", 0]["ts_raw"] == "1"


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"timestamp": "t1", "event": "e", "severity": "high"}, {"@timestamp": "t2", "message": "m", "level": "low"}, {"n": 1}]')
    (tmp_path / "o.json").write_text('{"events": [1]}')
    (tmp_path / "bad.json").write_text("{")
    rows = text.read_json(spark, [f"{tmp_path}/{n}.json" for n in ("a", "o", "bad")]).orderBy("seq").collect()
    assert [(r["ts_raw"], r["severity"], r["message"]) for r in rows] == [("t1", "high", "e"), ("t2", "low", "m"), ("", "info", '{"n":1}')]
    assert text.json_structure({"a": [1, 2], "b": {"c": "x"}}) == {"a": "[2 elements]", "b": {"c": "str"}}


EVENT = '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="P"/><EventID>{code}</EventID><Level>2</Level><TimeCreated SystemTime="2024-01-02T03:04:05Z"/><Computer>PC</Computer></System><EventData><Data Name="A">1</Data><Data Name="A">2</Data><Data>x</Data></EventData></Event>'


def test_event_xml(spark, tmp_path):
    (tmp_path / "e.xml").write_text("\n".join([EVENT.format(code=4625), "<Event><broken", EVENT.format(code=1), "<Event xmlns='x'><Other/></Event>"]))
    rows = text.read_event_xml(spark, f"{tmp_path}/e.xml").orderBy("seq").collect()
    assert [(r["event_code"], r["severity"], r["host"], r["provider"], r["data"]) for r in rows] == [(4625, "high", "PC", "P", {"A": "2"}), (1, "high", "PC", "P", {"A": "2"})]
    assert text.read_event_xml(spark, f"{tmp_path}/e.xml", codes="1, x").count() == 1
    assert text.read_event_xml(spark, f"{tmp_path}/e.xml", unnamed="Data").first()["data"] == {"A": "2", "Data2": "x"}


def prefetch_bytes():
    b = bytearray(0x100)
    b[0:4], b[4:8] = struct.pack("<I", 23), b"SCCA"
    b[0x10:0x4C] = "NOTEPAD.EXE".encode("utf-16-le").ljust(60, b"\0")
    b[0x4C:0x50], b[0x98:0x9C] = struct.pack("<I", 0xAB12), struct.pack("<I", 7)
    return bytes(b)


def lnk_bytes(arguments="-enc powershell", clsid="0114020000000000C000000000000046"):
    head = bytearray(0x4C)
    head[0:4], head[4:20] = struct.pack("<I", 0x4C), bytes.fromhex(clsid)
    head[20:24] = struct.pack("<I", 0x2 | 0x20 | 0x80)
    head[28:36] = struct.pack("<Q", 133500000000000000)
    path = b"C:\\Windows\\notepad.exe\0"
    info = bytearray(0x20)
    info[0:4], info[0x10:0x14] = struct.pack("<I", 0x20 + len(path)), struct.pack("<I", 0x20)
    return bytes(head) + bytes(info) + path + struct.pack("<H", len(arguments)) + arguments.encode("utf-16-le")


def test_binaries(spark, tmp_path):
    (tmp_path / "a.pf").write_bytes(prefetch_bytes())
    (tmp_path / "m.pf").write_bytes(b"MAM\x04" + bytes(60))
    (tmp_path / "z.pf").write_bytes(b"tiny")
    rows = {r["path"][-4:]: r for r in binary.prefetch(binary.read_files(spark, f"{tmp_path}", "*.pf")).collect()}
    assert (rows["a.pf"]["executable"], rows["a.pf"]["run_count"], rows["a.pf"]["hash"]) == ("NOTEPAD.EXE", 7, "0000AB12")
    assert rows["m.pf"]["compressed"] and rows["z.pf"]["error"] == "invalid signature"
    (tmp_path / "l.lnk").write_bytes(lnk_bytes())
    (tmp_path / "s.lnk").write_bytes(b"\x4c")
    (tmp_path / "w.lnk").write_bytes(lnk_bytes(clsid="00" * 16))
    rows = {r["path"][-5:]: r for r in binary.shortcuts(binary.read_files(spark, f"{tmp_path}", "*.lnk")).collect()}
    assert (rows["l.lnk"]["target_path"], rows["l.lnk"]["arguments"], rows["l.lnk"]["severity"]) == ("C:\\Windows\\notepad.exe", "-enc powershell", "high")
    assert rows["l.lnk"]["created"].year == 2024
    assert (rows["s.lnk"]["error"], rows["w.lnk"]["error"]) == ("too short", "wrong class id")


def history(path, kind):
    db = sqlite3.connect(path)
    if kind == "chromium":
        db.execute("CREATE TABLE urls(id INT, url TEXT, title TEXT, visit_count INT, last_visit_time INT)")
        db.executemany("INSERT INTO urls VALUES(?,?,?,?,?)", [(1, "https://evil.com/a", "t", 2, 13350000000000000), (2, "https://b.org", None, None, 13350000001000000), (3, "c", "x" * 300, 1, 0)])
    elif kind == "firefox":
        db.execute("CREATE TABLE moz_places(id INT, url TEXT, title TEXT, visit_count INT, last_visit_date INT)")
        db.execute("INSERT INTO moz_places VALUES(1,'https://f.net','f',1,1700000000000000)")
    else:
        db.execute("CREATE TABLE foo(x)")
    db.commit()
    db.close()


def test_browser_history(spark, tmp_path):
    for kind in ("chromium", "firefox", "other"):
        history(tmp_path / f"{kind}.sqlite", kind)
    rows = binary.browser_history(binary.read_files(spark, f"{tmp_path}")).orderBy("path", "seq").collect()
    assert [(r["browser"], r["url"], r["visits"]) for r in rows if r["error"] is None] == [("chromium", "https://b.org", 0), ("chromium", "https://evil.com/a", 2), ("chromium", "c", 1), ("firefox", "https://f.net", 1)]
    assert [r["error"] for r in rows if r["error"]] == ["no browser history"]
    assert len(rows[2]["title"]) == 200 and str(rows[1]["visited_at"]) == "2024-01-17 21:20:00"


def test_dispatch_and_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.pf").write_bytes(prefetch_bytes())
    (tmp_path / "x.txt").write_text("one line\nerror two\n")
    (tmp_path / "r.json").write_text('[{"event": "e"}]')
    (tmp_path / "f.csv").write_text("time,a\n1,2\n3,4\n")
    history(tmp_path / "History", "chromium")
    counts = {r["parser"]: r["count"] for r in dispatch.read_evidence(spark, f"{tmp_path}").groupBy("parser").count().collect()}
    assert counts == {"prefetch": 1, "log": 2, "json": 1, "csv": 2, "browser": 3}
    listed = {r["name"]: r for r in binary.inventory(spark, f"{tmp_path}").collect()}
    assert listed["a.pf"]["type"] == "Prefetch Windows" and listed["History"]["type"] == "Inconnu (sans extension)" and listed["x.txt"]["size_bytes"] == 19


def test_byte_patterns(spark, tmp_path):
    (tmp_path / "b.bin").write_bytes(b"xxMZxxMZ")
    rows = binary.byte_patterns(binary.read_files(spark, f"{tmp_path}"), {"mz": b"MZ"}).collect()
    assert [(r["rule"], r["offset"]) for r in rows] == [("mz", 2), ("mz", 6)]


def test_event_log_files_need_a_package(spark, tmp_path):
    (tmp_path / "e.evtx").write_bytes(b"ElfFile")
    pytest.importorskip("pyspark")
    try:
        import evtx  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            binary.read_evtx(binary.read_files(spark, f"{tmp_path}"))


def test_line_order_over_splits(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i:07d} {'x' * (i % 50)}\n" for i in range(90_000)))
    (tmp_path / "small.log").write_text("line 0\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        lines = text.read_log(spark, f"{tmp_path}/big.log")
        assert lines.rdd.getNumPartitions() > 2
        rows = lines.orderBy("seq").select("message").collect()
        assert [r["message"][5:12] for r in rows] == [f"{i:07d}" for i in range(90_000)]
        assert text.read_log(spark, [f"{tmp_path}/big.log", f"{tmp_path}/small.log"], max_lines=3).count() == 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
