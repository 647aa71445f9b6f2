"""Folders of mixed evidence whose files are larger than a split."""

import csv
import io
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sleuthframe.plans import catalogue, readings  # noqa: F401  (registers the queries of the readers)
from sleuthframe.sources import binary, csvfiles, dispatch

from .conftest import SMALL


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_every_csv_file_has_its_header(spark, small_splits):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    rows = catalogue.QUERIES["read_mixed_folder"](spark, SMALL).select("parser", "severity", "n").collect()
    assert sorted(map(tuple, rows)) == sorted(con.execute(f"SELECT parser, severity, n FROM ({catalogue.SQL['read_mixed_folder']})").fetchall())


def test_large_csv_files_are_split(spark, small_splits, tmp_path):
    (tmp_path / "big file.csv").write_text("time,level,note\n" + "".join(f"{i},high,{'x' * 50}\n" for i in range(80_000)))
    (tmp_path / "small.csv").write_text("time;a\n1;2\n3;4\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    rows = dispatch.read_evidence(spark, str(tmp_path))
    assert rows.filter("source_file like '%big file.csv'").select(F.spark_partition_id()).distinct().count() >= 4
    assert [r["ts_raw"] for r in rows.filter("severity = 'high'").orderBy("seq").select("ts_raw").collect()] == [str(i) for i in range(80_000)]
    assert rows.count() == 80_002


def odd_file(delimiter, quote, end, seed, headed=True):
    """Cells with line ends, quotes and delimiters; ragged and blank rows; quotes inside bare cells."""
    rng, out = random.Random(seed), io.StringIO(newline="")
    writer = csv.writer(out, delimiter=delimiter, quotechar=quote, lineterminator=end)
    writer.writerows([["Event Time", "Level", "note", "a"]] if headed else [])
    bits = ["x", quote, delimiter, "\n", "\r\n", "\r", " ", "\u00e9", quote * 2, delimiter + quote, "\n" + quote, "\n" * 300]
    for i in range(1500):
        note = "".join(rng.choices(bits, [30, 2, 2, 3, 1, 1, 5, 3, 1, 1, 1, 0.1], k=rng.randrange(12)))
        writer.writerow([f"2024-01-{i % 28 + 1:02d}", rng.choice(["high", "WARN", ""]), f'say {quote}hi{quote}{delimiter} {note}', i, *["more"] * (i % 50 == 0)][: 2 if i % 70 == 1 else 9])
        out.write(end * (i % 90 == 0) + f"bare{quote}x{quote}{delimiter}y{end}" * (i % 60 == 0))
    return out.getvalue()


ODD = {"semi": (";", '"', "\n"), "windows": (",", '"', "\r\n"), "tab": ("\t", '"', "\n"), "single": ("|", "'", "\n"), "bare": (",", '"', "\n", False)}


@pytest.mark.parametrize("name", ODD)
def test_split_files_read_as_whole_ones(spark, small_splits, tmp_path, monkeypatch, name):
    delimiter, quote, end, *headed = ODD[name]
    for k in range(2):
        body = odd_file(delimiter, quote, end, k, *headed)
        (tmp_path / f"{k}.csv").write_bytes(b"\xef\xbb\xbf" * k + body.encode() + b"\xff,open\n" + (b"" if k else f"x{delimiter}{quote}never closed\n\n".encode()))
    read = lambda: [tuple(r) for r in binary.read_csv_files(spark, str(tmp_path), "*.csv").orderBy("source_file", "seq").select("source_file", "ts_raw", "severity", "message", F.map_entries("data")).collect()]
    whole = read()
    monkeypatch.setattr(csvfiles, "WHOLE_BYTES", 0)
    assert read() == whole and len(whole) > 3000
    numbers = binary.read_csv_files(spark, str(tmp_path), "*.csv").groupBy("source_file", "seq").count().filter("count > 1")
    assert numbers.count() == 0


def test_a_quote_that_never_closes_is_an_error(spark, small_splits, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("time,note\n" + "1,2\n" * 4000 + '3,"' + "four\n" * 40_000)
    for most in (csvfiles.WHOLE_BYTES, 0):
        monkeypatch.setattr(csvfiles, "WHOLE_BYTES", most)
        with pytest.raises(Exception, match="field larger than field limit"):
            binary.read_csv_files(spark, str(tmp_path), "*.csv").collect()


def test_names_of_csv_files(spark, tmp_path):
    names = ("a.csv", "A.Csv", ".csv", "..csv", "a..csv", "csv", "a.csv.txt", "History.csv", ".a.csv", "a b+c%20.csv")
    for i, name in enumerate(names):
        (tmp_path / f"{i}").mkdir()
        (tmp_path / f"{i}" / name).write_text("x\n")
    name = F.col("_metadata.file_name")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    wanted = listed.load(str(tmp_path)).filter(dispatch.reader_of(name) == "csv").select("path").collect()
    assert sorted(wanted) == sorted(listed.option("pathGlobFilter", dispatch._CSV_NAMES).load(str(tmp_path)).select("path").collect()) and len(wanted) == 4
