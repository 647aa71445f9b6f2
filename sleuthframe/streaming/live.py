"""Near-real-time forms: watched drop folder, window counters, sessions, counters with a time to live."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import columns as C
from ..functions import fixed


def inbox_ignored(name):
    """Whether a file of the drop folder is to be left alone: notes, dotfiles, partial copies."""
    partial = [F.lower(name).endswith(s) for s in fixed.INBOX_IGNORED_SUFFIXES]
    out = name.isin(*fixed.INBOX_IGNORED_NAMES) | name.startswith(".")
    for p in partial:
        out = out | p
    return out


def drop_folder(spark: SparkSession, inbox: str, archive: str | None = None, settle_seconds: float = 2, log: str | None = None, content: bool = True) -> DataFrame:
    """Stream of (path, name, case_name, modificationTime, length, content) of files put into a folder.

    A file is taken once, and only when two scans, ``settle_seconds`` apart, have found all of its
    loose file or folder unchanged (``inbox.InboxSource``); with ``archive`` finished files are
    moved there.
    """
    from .inbox import InboxSource

    spark.dataSource.register(InboxSource)
    reader = spark.readStream.format("inbox").option("path", inbox).option("settle", settle_seconds).option("content", str(content).lower())
    for name, value in (("archive", archive), ("log", log)):
        if value:
            reader = reader.option(name, value)
    return reader.load()


def settled(listing: DataFrame, before: DataFrame, handled: DataFrame) -> DataFrame:
    """Rows of a listing (path, length, ...) that may be taken: of the same length in the scan before, not handled yet, not to be ignored.

    A file that is still being written grows between two scans and waits for the next one.
    """
    same = listing.join(before.select("path", "length"), ["path", "length"], "left_semi")
    return same.join(handled.select("path"), "path", "left_anti").filter(~inbox_ignored(C.base_name(F.col("path"))))


def watch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, seconds: int = 10) -> StreamingQuery:
    """Runs ``handle(batch, id)`` on new rows; the checkpoint makes each file count once for a handler that is idempotent by id."""
    writer: DataStreamWriter = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(2, seconds)} seconds")).start()


@contextlib.contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, beyond the memory of executors."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def windowed_counts(events: DataFrame, at: str, key: str, late: str = "10 minutes", size: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    """(window_start, key, n) of sliding event-time windows; state older than the watermark is dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, size, slide), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def session_counts(events: DataFrame, at: str, key: str, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), key, "n")


def deduplicated(events: DataFrame, at: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def ttl_counters(events: DataFrame, key: str, at: str, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    """(key, at, counter): a counter for each key that starts at its first hit, lives ``ttl_seconds`` and isn't prolonged.

    ``at`` in the result is in microseconds.  State is two numbers a key, kept by Spark's state
    store, and is dropped when the watermark has passed the end of its life.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ttl = ttl_seconds * 1_000_000

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until, n = state.get if state.exists else (0, 0)
        out = []
        for t in sorted(t for b in batches for t in b["at"].tolist()):
            n = 1 if n == 0 or t >= until else n + 1
            until = t + ttl if n == 1 else until
            out.append((keys[0], t, n))
        state.update((until, n))
        state.setTimeoutTimestamp(max(until // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "at", "counter"])

    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(at, late).select(F.col(key).alias("key"), F.col(at).alias("event_time"), F.unix_micros(at).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, at long, counter long", "until long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def hits_per_window(events: DataFrame, key: str, at: str, window_seconds: int, order: str, late: str = "10 minutes") -> DataFrame:
    """(key, at, order, hits_in_window) of a stream: at each hit the number of its key's hits in the window before it, itself included.

    The window is open at its far end (now - t < window), as in ``windows.sliding_hits``; hits of one
    instant count those before them by ``order``, a whole number.  A hit is counted when it arrives: one that comes
    after later hits doesn't change what these were told.

    State is a list of blocks of hit times a key, one a batch; blocks that no hit can reach any
    more are dropped, and a timer clears a key when the watermark has passed its last window.
    ``at`` in the result is in microseconds.  Needs the RocksDB state store.
    """
    kind = events.schema[key].dataType.simpleString()
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = events.withWatermark(at, late).select(F.col(key).alias("key"), F.col(at).alias("event_time"), micros.alias("at"), F.col(order).cast("long").alias("order"))
    counter = _WindowHits(window_seconds * 1_000_000)
    return rows.groupBy("key").transformWithStateInPandas(counter, f"key {kind}, at long, order long, hits_in_window long", "Append", "EventTime")


class _WindowHits(StatefulProcessor):
    """Counts hits against blocks of the times seen before (last time, times as 64-bit integers in order)."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", "last long, times binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at", "order"], kind="stable")
        at = new["at"].to_numpy(np.int64)
        kept = [tuple(b) for b in self.blocks.get()]
        seen = np.sort(np.concatenate([np.frombuffer(times, np.int64) for last, times in kept if last > at[0] - self.width] or [at[:0]]))
        old = np.searchsorted(seen, at, "right") - np.searchsorted(seen, at - self.width, "right")
        own = np.arange(1, len(at) + 1) - np.searchsorted(at, at - self.width, "right")
        # What a later hit may still look back at: anything younger than the watermark's window.
        floor = timerValues.getCurrentWatermarkInMs() * 1000 - self.width
        kept.append((int(at[-1]), at.tobytes()))
        self.blocks.put([b for b in kept if b[0] > floor])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(max(b[0] for b in kept) + self.width) // 1000 + 1)
        yield pd.DataFrame({"key": key[0], "at": at, "order": new["order"].to_numpy(), "hits_in_window": old + own})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.blocks.clear()
        return iter(())

    def close(self) -> None:
        pass


class Progress(StreamingQueryListener):
    """Keeps the latest progress of each query and hands it to ``tell`` (name, batch, rows)."""

    def __init__(self, tell: Callable[[str, int, int], None]):
        self.tell = tell
        self.latest: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.tell(event.name or str(event.id), -1, 0)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self.latest[progress.name or str(progress.id)] = progress.batchId
        self.tell(progress.name or str(progress.id), progress.batchId, progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
