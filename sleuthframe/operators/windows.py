"""Counters over time: sliding windows, fixed windows from the first hit, first-N, last write, histograms."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from ..sources import staging


def sliding_hits(hits: DataFrame, key: str, micros: Column, window_seconds: int, order: str) -> DataFrame:
    """``hits`` plus ``hits_in_window``: hits of the key in the window before and at each one, itself included.

    The window is open at its far end (now - t < window).  Hits of one instant count those
    recorded before them by ``order``, not their later peers.  Hits without a time count
    among themselves.

    Time is cut into blocks as long as the window, and a hit also stands in the block after
    its own, where it is only looked back at.  So a busy key is spread over as many tasks as
    it has blocks.
    """
    width = window_seconds * 1_000_000
    block = F.floor(F.col("__t") / F.lit(width))
    blocks = F.when(F.col("__t").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(block, block + 1))
    timed = hits.withColumn("__t", micros).select("*", F.posexplode(blocks).alias("__back", "__block"))
    span = Window.partitionBy(key, "__block").orderBy("__t").rangeBetween(-(width - 1), 0)
    peers = Window.partitionBy(key, "__block", "__t")
    later = F.count("*").over(peers) - F.row_number().over(peers.orderBy(order))
    return timed.withColumn("hits_in_window", F.count("*").over(span) - later).filter("__back = 0").drop("__t", "__back", "__block")


def rate_limited(hits: DataFrame, key: str, micros: Column, window_seconds: int, most: int, order: str) -> DataFrame:
    """Hits over the limit; rejected hits count as hits too."""
    return sliding_hits(hits, key, micros, window_seconds, order).filter(F.col("hits_in_window") > most)


#: Entry of a key's first block: no window is open.
_NEVER = -(2**63)


class _Map:
    """What a block of a key's hits makes of the state (until, n) that it is entered with: the end of the open window and the hits in it.

    A window starts at the first hit at or after ``until``.  So the block is a step function:
    entered with until <= bounds[i] (the first such i) it is left with exits[i] and tails[i];
    beyond the last bound no window starts, and its ``size`` hits are added to n.  ``reach`` is
    the largest until that it can be entered with, a life after its first hit.
    """

    def __init__(self, bounds: np.ndarray, exits: np.ndarray, tails: np.ndarray, size: int, reach: int):
        self.bounds, self.exits, self.tails, self.size, self.reach = bounds, exits, tails, size, reach

    @classmethod
    def of(cls, t: np.ndarray, ttl: int) -> _Map:
        """The map of hits at sorted times: pointers to each hit's successor are doubled until all point to the last window of the block."""
        n = len(t)
        last = np.searchsorted(t, t + ttl)
        last = np.where(last < n, last, np.arange(n))
        while not np.array_equal(further := last[last], last):
            last = further
        own = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        return cls(t[own], t[last[own]] + ttl, n - last[own], n, int(t[0]) + ttl)._short()

    def _short(self) -> _Map:
        """Without bounds beyond reach, and those that a larger one has the same end for."""
        near = slice(0, int(np.searchsorted(self.bounds, self.reach)) + 1)
        bounds, exits, tails = self.bounds[near], self.exits[near], self.tails[near]
        keep = np.append(exits[:-1] != exits[1:], True) if len(exits) else np.zeros(0, bool)
        return _Map(bounds[keep], exits[keep], tails[keep], self.size, self.reach)

    def apply(self, until: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.bounds, until)
        inside = at < len(self.bounds)
        some = np.minimum(at, max(len(self.bounds) - 1, 0))
        if not len(self.bounds):
            return until, n + self.size
        return np.where(inside, self.exits[some], until), np.where(inside, self.tails[some], n + self.size)

    def then(self, after: _Map) -> _Map:
        """This block and the next one as one block."""
        exits, tails = after.apply(self.exits, self.tails)
        new = after.bounds > (self.bounds[-1] if len(self.bounds) else _NEVER)
        return _Map(np.append(self.bounds, after.bounds[new]), np.append(exits, after.exits[new]), np.append(tails, after.tails[new]), self.size + after.size, self.reach)._short()

    def row(self) -> dict:
        return {"bounds": self.bounds.tobytes(), "exits": self.exits.tobytes(), "tails": self.tails.tobytes(), "size": self.size, "reach": self.reach}

    @classmethod
    def read(cls, row: Mapping) -> _Map:
        return cls(*(np.frombuffer(row[c], np.int64) for c in ("bounds", "exits", "tails")), row["size"], row["reach"])


_MAP = "bounds binary, exits binary, tails binary, size long, reach long"


def _blocks(placed: DataFrame, key: str, kind: str, ttl: int) -> DataFrame:
    """(key, timed, part, first, maps): the maps of the keys at the start and the end of each partition, the only ones that can go on in another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ends, times = TaskContext.get().partitionId(), [], []

        def done() -> None:
            if times:
                t = np.concatenate(times)
                ends.append((current, len(ends) == 0, _Map.of(t, ttl) if current[1] else _Map(t[:0], t[:0], t[:0], len(t), _NEVER)))
                del ends[1:-1]
                times.clear()

        current = None
        for batch in batches:
            keys, t = batch.column(0), batch.column(1)
            timed = pc.is_valid(t)
            edge = _changes(keys, timed)
            filled = pc.fill_null(t, 0).to_numpy()
            for lo, hi in itertools.pairwise([*edge.tolist(), batch.num_rows]):
                own = (keys[lo].as_py(), timed[lo].as_py())
                if own != current:
                    done()
                    current = own
                times.append(filled[lo:hi])
        done()
        rows = [{"key": k, "timed": timed, "part": part, "first": first} | m.row() for (k, timed), first, m in ends]
        yield from pa.Table.from_pylist(rows, pa.schema([("key", key_type), ("timed", pa.bool_()), ("part", pa.int32()), ("first", pa.bool_()), ("bounds", pa.binary()), ("exits", pa.binary()), ("tails", pa.binary()), ("size", pa.int64()), ("reach", pa.int64())])).to_batches()

    key_type = to_arrow_type(placed.schema[key].dataType)
    return placed.select(F.col(key).alias("key"), "__t").mapInArrow(run, f"key {kind}, timed boolean, part int, first boolean, {_MAP}")


def _changes(keys: pa.Array, timed: pa.Array) -> np.ndarray:
    """Where rows of another (key, timed) begin."""
    if not len(keys):
        return np.zeros(0, np.int64)
    code = keys.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) * 2 + timed.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))


def _entries(blocks: DataFrame, kind: str, parts: int) -> dict[int, tuple[int, int]]:
    """State (until, n) by partition with which its first key goes on from the partitions before; a row a partition at most.

    Maps are composed by runs of about the root of the number of partitions: each run to one
    map, the runs of a key in order, then the blocks of each run from the run's entry.  No task
    sees the maps of all partitions.
    """
    run = max(2, math.isqrt(parts))
    several = blocks.withColumn("of", F.count("*").over(Window.partitionBy("key", "timed"))).filter("of > 1").withColumn("run", F.floor(F.col("part") / run).cast("int"))

    def compose(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        whole = functools.reduce(lambda a, r: a.then(_Map.read(r)), rows[1:], _Map.read(rows[0]))
        return pa.Table.from_pylist([{"key": rows[0]["key"], "timed": rows[0]["timed"], "run": rows[0]["run"]} | whole.row()], group.select(["key", "timed", "run", "bounds", "exits", "tails", "size", "reach"]).schema)

    def walk(order: str):
        def fold(group: pa.Table) -> pa.Table:
            rows, out = sorted(group.to_pylist(), key=lambda r: r[order]), []
            until, n = np.array([rows[0].get("until", _NEVER)]), np.array([rows[0].get("n", 0)])
            for r in rows:
                out.append({"key": r["key"], "timed": r["timed"], order: r[order], "until": int(until[0]), "n": int(n[0])})
                until, n = _Map.read(r).apply(until, n)
            return pa.Table.from_pylist(out, pa.schema([group.schema.field("key"), group.schema.field("timed"), group.schema.field(order), ("until", pa.int64()), ("n", pa.int64())]))

        return fold

    runs = several.groupBy("key", "timed", "run").applyInArrow(compose, f"key {kind}, timed boolean, run int, {_MAP}")
    starts = runs.groupBy("key", "timed").applyInArrow(walk("run"), f"key {kind}, timed boolean, run int, until long, n long")
    starts = starts.select(*[F.col(c).alias(f"__{c}") for c in ("key", "timed", "run")], "until", "n")
    same = F.col("key").eqNullSafe(F.col("__key")) & (F.col("timed") == F.col("__timed")) & (F.col("run") == F.col("__run"))
    entered = several.join(starts, same).drop("__key", "__timed", "__run").groupBy("key", "timed", "run").applyInArrow(walk("part"), f"key {kind}, timed boolean, part int, until long, n long")
    first = several.groupBy("key", "timed").agg(F.min("part").alias("__start"))
    kept = entered.join(first.withColumnsRenamed({"key": "__key", "timed": "__timed"}), F.col("key").eqNullSafe(F.col("__key")) & (F.col("timed") == F.col("__timed"))).filter("part > __start")
    return {r["part"]: (r["until"], r["n"]) for r in kept.select("part", "until", "n").collect()}


def fixed_window_hits(hits: DataFrame, key: str, micros: Column, ttl_seconds: int, order: str) -> DataFrame:
    """``hits`` plus ``counter``: a counter that starts at the first hit, lives ttl seconds and isn't prolonged.

    A window ends only where its successor starts, which depends on all hits of the key before.
    Hits are dealt by range of (key, time), so a busy key is as many partitions as it has
    rows for.  Each of its blocks is turned into a map from the state that it is entered with
    to the one that it is left with (``_Map``); maps are composed, which gives the entry of every
    block, and the blocks are numbered in parallel.  Only the first and last key of a partition
    can go on in another, so there are two maps a partition at most.

    Hits without a time come first in their key and count among themselves.
    """
    spark, ttl = hits.sparkSession, ttl_seconds * 1_000_000
    by = [F.col(key).asc_nulls_first(), F.col("__t").asc_nulls_first(), F.col(order).asc_nulls_first()]
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(staging.folder(spark, "checkpoints"))
    # Both passes must see the same partitions: they are written, and keep their order.
    placed = hits.withColumn("__t", micros).repartitionByRange(*by).sortWithinPartitions(*by).checkpoint()
    kind, parts = placed.schema[key].dataType.simpleString(), placed.rdd.getNumPartitions()
    entries = _entries(_blocks(placed, key, kind, ttl), kind, parts) if parts > 1 else {}
    shared = spark.sparkContext.broadcast(entries)
    schema = StructType([*placed.drop("__t").schema.fields, StructField("counter", LongType())])
    names = schema.names[:-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, until, n = None, *shared.value.get(TaskContext.get().partitionId(), (_NEVER, 0))
        for batch in batches:
            keys, t = batch.column(key), batch.column("__t")
            timed = pc.is_valid(t)
            filled, counters = pc.fill_null(t, 0).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for lo, hi in itertools.pairwise([*_changes(keys, timed).tolist(), batch.num_rows]):
                own = (keys[lo].as_py(), timed[lo].as_py())
                if current is not None and own != current:
                    until, n = _NEVER, 0
                current = own
                while lo < hi:
                    stop = lo + int(np.searchsorted(filled[lo:hi], until)) if own[1] else hi
                    counters[lo:stop] = np.arange(n + 1, n + 1 + stop - lo)
                    n, lo = n + stop - lo, stop
                    if lo < hi:
                        until, n = int(filled[lo]) + ttl, 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(counters)], names=schema.names)

    return placed.mapInArrow(count, schema)


def last_write(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The latest row of each key."""
    latest = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n")


def numbered(rows: DataFrame, scope: Sequence[str], order: str, name: str = "id") -> DataFrame:
    """Sequential numbers 1, 2, ... inside each scope."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*scope).orderBy(order)))


def running_number(rows: DataFrame, keys: Sequence[str], order: str, name: str, block: int = 1 << 20) -> DataFrame:
    """``rows`` plus ``name``: 1, 2, ... inside each key in the order of ``order``, unique there.

    A whole-number order is cut into blocks of ``block`` values, so a task sorts no more rows
    of a key than that, however busy the key; rows are counted by block first and a row's
    number is that in its block plus the counts before.  Only one row a block is summed in
    order.  Other orders are numbered by key.
    """
    if not isinstance(rows.schema[order].dataType, IntegralType):
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long"))
    cut = rows.withColumn("__b", F.floor(F.col(order) / F.lit(block)))
    counts = cut.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__kb"), before.alias("__start"))
    same = F.col("__b").eqNullSafe(F.col("__kb"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = cut.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(order)).cast("long"))
    return inside.join(starts, same).withColumn(name, F.col(name) + F.col("__start")).drop("__b", "__start", "__kb", *[f"__k{i}" for i in range(len(keys))])


def cumulative_buckets(values: DataFrame, column: str, bounds: Sequence[float]) -> DataFrame:
    """(le, n): observations at or below each bound, and +Inf; one pass."""
    sums = values.agg(*[F.count_if(F.col(column) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(column).alias("inf"))
    pairs = [F.struct(F.lit(str(float(b))).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("n"))]
    return sums.select(F.explode(F.array(*pairs)).alias("x")).select("x.le", "x.n")
