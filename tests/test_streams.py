"""The drop folder, and counters of streams over several batches."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from sleuthframe.operators import windows
from sleuthframe.streaming import inbox, live


def drain(stream, seen, checkpoint):
    run = live.watch(stream, lambda df, i: seen.extend(tuple(r) for r in df.select("name", "case_name", "length", F.col("content").cast("string")).collect()), checkpoint, once=True)
    assert run.awaitTermination(90) and run.exception() is None


def test_drop_folder(spark, tmp_path):
    box = tmp_path / "inbox"
    (box / "incident-web" / "deep").mkdir(parents=True)
    for name in ("LISEZMOI.txt", "transfert.part", "evidence.log", "incident-web/a.log", "incident-web/deep/b.log", "incident-web/c.TMP", ".hidden"):
        (box / name).write_text("x")
    seen = []
    drain(live.drop_folder(spark, f"file://{box}", settle_seconds=0.2), seen, f"file://{tmp_path}/cp")
    assert sorted(seen) == [("a.log", "incident-web", 1, "x"), ("b.log", "incident-web", 1, "x"), ("evidence.log", "inbox", 1, "x")]


def test_restart_reads_nothing_twice_and_archives(spark, tmp_path):
    box, seen = tmp_path / "inbox", []
    box.mkdir()
    (box / "one.log").write_text("1")
    stream = lambda: live.drop_folder(spark, str(box), archive=str(tmp_path / "done"), settle_seconds=0.2, log=str(tmp_path / "log"))
    drain(stream(), seen, f"file://{tmp_path}/cp")
    (box / "case").mkdir()
    (box / "case" / "two.log").write_text("22")
    drain(stream(), seen, f"file://{tmp_path}/cp")
    drain(stream(), seen, f"file://{tmp_path}/cp")
    assert sorted(s[0] for s in seen) == ["one.log", "two.log"]
    # A batch is known to be done when the next one is planned.
    assert (tmp_path / "done" / "one.log").exists() and not (box / "one.log").exists()


def test_a_growing_file_is_read_once_and_whole(spark, tmp_path):
    """A writer appends through several triggers; a file of another case isn't held up by it."""
    box, seen = tmp_path / "inbox", []
    (box / "slow").mkdir(parents=True)
    (box / "fast.log").write_text("done")

    def write():
        with open(box / "slow" / "big.log", "w") as f:
            for i in range(30):
                f.write(f"line {i}\n")
                f.flush()
                time.sleep(0.1)

    writer = threading.Thread(target=write)
    writer.start()
    time.sleep(0.2)
    stream = live.drop_folder(spark, str(box), settle_seconds=0.6)
    run = stream.writeStream.foreachBatch(lambda df, i: seen.extend((i, *r) for r in df.select("name", F.col("content").cast("string")).collect())).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(processingTime="300 milliseconds").start()
    writer.join()
    end = time.time() + 60
    while len(seen) < 2 and time.time() < end:
        time.sleep(0.3)
    run.stop()
    names = [s[1] for s in seen]
    assert sorted(names) == ["big.log", "fast.log"] and names[0] == "fast.log"
    assert dict(s[1:] for s in seen)["big.log"].count("\n") == 30


def test_a_batch_is_planned_again_from_the_log(tmp_path):
    box = tmp_path / "inbox"
    box.mkdir()
    (box / "a.log").write_text("a")
    reader = inbox.InboxReader({"path": str(box), "settle": "0"})
    end = reader.latestOffset()
    (box / "b.log").write_text("b")
    again = inbox.InboxReader({"path": str(box), "settle": "0"})
    assert again.latestOffset() == {"taken": 2}
    files = lambda r, a, b: [f.path for p in r.partitions({"taken": a}, {"taken": b}) for f in p.files]
    assert end == {"taken": 1} and files(again, 0, 1) == ["a.log"] and files(again, 1, 2) == ["b.log"]
    (box / "a.log").write_text("longer")
    assert again.latestOffset() == {"taken": 2}
    assert again.latestOffset() == {"taken": 3} and files(again, 2, 3) == ["a.log"]


def test_hits_per_window_over_batches(spark, tmp_path):
    """Batches in order of time give what the batch operator gives; an old block is dropped from the state."""
    rows = [(k, 1_700_000_000 + t, i) for i, (t, k) in enumerate(sorted((t * 7 % 900, f"u{t % 3}") for t in range(400)))]
    want = {(r["user"], r["seq"], r["hits_in_window"]) for r in windows.sliding_hits(spark.createDataFrame(rows, "user string, s long, seq long"), "user", F.col("s") * 1_000_000, 60, "seq").collect()}
    schema, got = "user string, s long, seq long", set()
    for n in range(4):
        spark.createDataFrame(rows[n * 100 : n * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_seconds("s"))
        with live.state_in_rocksdb(spark):
            run = live.hits_per_window(events, "user", "at", 60, "seq", late="5 seconds").writeStream.foreachBatch(lambda df, i: got.update((r["key"], r["order"], r["hits_in_window"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert run.exception() is None
    assert got == want


@pytest.mark.parametrize(("path", "wanted"), [("a.log", False), (".a", True), ("LISEZMOI.txt", True), ("x/.git/y", True), ("x/y.Partial", True), ("x/y.log", False)])
def test_ignored(path, wanted):
    assert inbox.ignored(path) is wanted
