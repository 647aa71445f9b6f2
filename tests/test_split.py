"""Large documents cut in parallel: JSON arrays, CSV with line ends in cells, event XML over lines."""

import csv
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sleuthframe.sources import binary, dispatch, split, text


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def value(rng, depth=0):
    kind = rng.randint(0, 8 if depth < 3 else 4)
    if kind > 6:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if kind > 4:
        return {f"k{i}": value(rng, depth + 1) for i in range(rng.randint(0, 4))}
    return rng.choice([1, None, True, "", 'a "q" b', "x\\", 'y\\"', "br}ace{", "[,]", "é漢\n", "\\\\", "}" * 50, "long " * 40])


def ordered(rows):
    return [json.loads(r["text"]) for r in sorted(rows, key=lambda r: (r["block"], r["n"]))]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_items(spark, tmp_path, small_splits, indent):
    rng = random.Random(indent or 1)
    items = [value(rng) for _ in range(900)]
    (tmp_path / "a.json").write_text(" \n " + json.dumps(items, indent=indent, ensure_ascii=False) + "\n")
    found = split.json_items(spark, str(tmp_path / "a.json"))
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 8
    assert ordered(found.collect()) == items


def test_json_documents_of_all_kinds(spark, tmp_path, small_splits):
    docs = {"empty": "[]", "blank": " ", "object": json.dumps({"items": [{"a": i} for i in range(500)]}), "number": "17", "one": '[{"a": [1, {"b": 2}]}]', "giant": json.dumps([{"x": "word } { " * 3000}, 2]), "open": '[{"a": 1}, {"a"', "quote": '[{"a": "x}, {"a": 1}]', "flat": json.dumps(list(range(20))), "nested": json.dumps([[{"a": 1}], [[]], {}])}
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(doc)
    by = {}
    for r in split.json_items(spark, str(tmp_path)).collect():
        by.setdefault(r["file"].rsplit("/", 1)[1][:-5], []).append(r)
    assert {k: ordered(v) for k, v in by.items()} == {k: json.loads(docs[k]) for k in ("one", "giant", "flat", "nested")}


def test_read_json_is_the_same_either_way(spark, tmp_path, small_splits):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"timestamp": f"t{i}", "severity": "high", "message": "m" * (i % 90), "n": i} for i in range(300 * k)]))
    columns = ["source_file", "ts_raw", "severity", "message", F.col("data")["item"].alias("item")]
    rows = [sorted(map(tuple, text.read_json(spark, str(tmp_path), split=s).select(*columns).collect())) for s in (True, False, None)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 900
    first = text.read_json(spark, str(tmp_path), max_items=2, split=True).select("source_file", "ts_raw").collect()
    assert sorted(r["ts_raw"] for r in first) == ["t0", "t0", "t1", "t1"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_with_line_ends_in_cells(spark, tmp_path, small_splits, end):
    """Equal to the one-task reading, for cells that hold quotes, separators and line ends of both kinds."""
    rng = random.Random(4)
    cell = lambda: rng.choice(["plain", "", 'say "hi"', "a,b", "two\nlines", "win\r\nlines", '"', ',"\n', "\n\n\n", '5" disk', "x" * 400, "é\n漢"])
    rows = [[f"2024-01-01 00:{i % 60:02d}", str(i), cell(), cell(), cell()] for i in range(700)]
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f, lineterminator=end)
        writer.writerow(["Event Time", "n", "one", "two\nnames", "three"])
        writer.writerows(rows)
    got = text.read_csv(spark, str(tmp_path / "a.csv"), ",", True, multiline=True).orderBy("seq").collect()
    assert [r["data"].get("n") for r in got] == [r[1] for r in rows]
    names = ["Event Time", "n", "one", "two\nnames", "three"]
    assert [[r["data"].get(c) for c in names] for r in got] == [[c or None for c in r] for r in rows]
    if end == "\n":
        whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "a.csv")).collect()
        assert [[r["data"].get(c) for c in names] for r in got] == [list(r) for r in whole]
    assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 8


@pytest.mark.parametrize(("line", "outside", "inside"), [("a,b", False, True), ('"a', True, False), ('"a"', False, False), ('a"b', False, False), ('x,"y', True, False), ('x","y', True, True), ('""', False, True), ('"""', True, False), ("", False, True), ('a,"b""c",d', False, False)])
def test_states_of_lines(line, outside, inside):
    got = split._line_states(pa.array([line]), ",")
    assert [bool(g[0]) for g in got] == [outside, inside]


EVENT = '<Event xmlns="x"><System><EventID>{i}</EventID><Level>2</Level><Computer>h{i}</Computer></System><EventData><Data Name="Note">a &lt;Event&gt; b</Data></EventData></Event>'


@pytest.mark.parametrize("layout", ["lines", "wrapped", "pretty", "run on"])
def test_event_xml_over_lines(spark, tmp_path, layout):
    events = [EVENT.replace("{i}", str(i)) for i in range(12_000)]
    pretty = [e.replace("><", ">\n  <") for e in events]
    body = {"lines": "\n".join(events), "wrapped": '<?xml version="1.0"?>\n<Events>\n' + "\n".join(pretty) + "\n</Events>\n", "pretty": "\r\n\r\n".join(pretty), "run on": "<Events>" + "".join(events) + "</Events>"}[layout]
    (tmp_path / "e.xml").write_text(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        read = text.read_event_xml(spark, str(tmp_path / "e.xml"))
        assert read.rdd.getNumPartitions() > 1
        rows = read.orderBy("seq").select("event_code", "host", F.col("data")["Note"].alias("note")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in rows] == [(i, f"h{i}", "a <Event> b") for i in range(12_000)]


def test_digests_of_large_files(spark, tmp_path):
    """A file of more than 2 GB, most of it a hole, is digested by chunks; smaller ones by Spark."""
    import hashlib

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("small")
    with open(tmp_path / "in" / "disk.img", "wb") as f:
        f.write(b"start")
        f.seek((2 << 30) + 77)
        f.write(b"end")
    got = {r["name"]: r for r in binary.inventory(spark, str(tmp_path / "in")).collect()}
    with open(tmp_path / "in" / "disk.img", "rb") as f:
        assert got["disk.img"]["sha256"] == hashlib.file_digest(f, "sha256").hexdigest() and got["disk.img"]["size_bytes"] == (2 << 30) + 80
    assert got["a.log"]["md5"] == hashlib.md5(b"small").hexdigest() and got["a.log"]["size_bytes"] == 5


def test_digests_by_chunks_equal_those_of_spark(spark, tmp_path, monkeypatch):
    for i in range(5):
        (tmp_path / f"{i}.log").write_bytes(bytes(range(256)) * i * 30)
    rows = lambda most: [tuple(r) for r in binary.inventory(spark, str(tmp_path), most).collect()]
    assert rows(10_000) == rows(1 << 20) == rows(-1)


def test_folder_of_evidence_is_listed_in_spark(spark, tmp_path):
    """Each reader opens only its own files."""
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.json").write_text('[{"message": "j"}]')
    (tmp_path / "b.log").write_text("one\ntwo\n")
    (tmp_path / "deep" / "c.CSV").write_text("time,x\n1,2\n")
    (tmp_path / "History").write_bytes(b"")
    found = dispatch.read_evidence(spark, str(tmp_path))
    assert sorted(r["parser"] for r in found.select("parser").collect()) == ["csv", "json", "log", "log"]
    logs = text.read_log(spark, str(tmp_path), where=dispatch.reader_of(F.col("_metadata.file_name")) == "log")
    assert {r[0].rsplit("/", 1)[1] for r in logs.select("source_file").distinct().collect()} == {"b.log"}


def test_structure_of_documents(spark):
    docs = ['{"a": 1, "b": {"c": [1, 2], "d": null}}', '{"a": "x", "b": {"c": [], "d": true}}', "[1, 2, 3]", "1.5", "not json", None, '{"a": {"a": {"a": {"a": {"a": {"a": 1}}}}}}']
    wide = json.dumps({"w": {f"k{i:02d}": i for i in range(30)}})
    rows = text.structure(spark.createDataFrame([(x,) for x in [*docs, wide]], "j string").select(F.try_parse_json("j").alias("v"))).collect()
    got = {(r["path"], r["kind"]): (r["depth"], r["n"], r["least"], r["most"]) for r in rows}
    assert got["$", "dict"] == (0, 4, 1, 2) and got["$", "list"] == (0, 1, 3, 3) and got["$", "float"] == (0, 1, None, None)
    assert got["$.b.c", "list"] == (2, 2, 0, 2) and got["$.b.d", "NoneType"][1] == got["$.b.d", "bool"][1] == 1 and got["$.a", "int"][1] == got["$.a", "str"][1] == 1
    assert got["$.a.a.a.a.a", "..."] == (5, 1, None, None) and not any(r["depth"] > 5 for r in rows)
    assert sum(r["path"].startswith("$.w.") for r in rows) == 20 and ("$.w.k20", "int") not in got and got["$.w", "dict"][2:] == (30, 30)
