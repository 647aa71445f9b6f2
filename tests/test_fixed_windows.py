"""Fixed windows from the first hit: maps of blocks, and busy keys over many partitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sleuthframe.operators import windows


def naive(times, ttl):
    until, n, out = None, 0, []
    for t in times:
        if until is None or t >= until:
            until, n = t + ttl, 0
        n += 1
        out.append(n)
    return out


def walked(times, until, n, ttl):
    for t in times:
        if t >= until:
            until, n = t + ttl, 0
        n += 1
    return until, n


@pytest.mark.parametrize("seed", range(30))
def test_maps_compose(seed):
    """Blocks of any density, entered in any state that can be: one by one, composed, and in any grouping."""
    rng = random.Random(seed)
    ttl, t, times = rng.choice([1, 7, 50, 400]), 0, []
    for _ in range(rng.randint(2, 120)):
        t += rng.choice([0, 0, 1, 2, rng.randint(0, 3 * ttl)])
        times.append(t)
    cuts = sorted({0, len(times), *(rng.randint(0, len(times)) for _ in range(rng.randint(1, 8)))})
    blocks = [times[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    maps = [windows._Map.of(np.array(b, np.int64), ttl) for b in blocks]
    whole = maps[0]
    for m in maps[1:]:
        whole = whole.then(m)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = m.then(right)
    for until in [windows._NEVER, *range(times[0] - 2, times[0] + ttl + 1)]:
        want = walked(times, until, 5, ttl)
        for m in (whole, right, windows._Map.read(whole.row())):
            got = m.apply(np.array([until]), np.array([5]))
            assert (int(got[0][0]), int(got[1][0])) == want


def test_coalescing_maps_are_small():
    """After some windows all entries have met, so a long block is a short map."""
    rng = np.random.default_rng(1)
    times = np.cumsum(rng.integers(1, 50, 100_000))
    assert len(windows._Map.of(times, 1000).bounds) <= 25


@pytest.mark.parametrize("ttl", [1, 40, 100_000])
def test_a_key_with_half_of_all_hits(spark, ttl):
    rng = random.Random(ttl)
    rows = [(("busy" if rng.random() < 0.5 else f"k{rng.randint(0, 30)}") if i % 50 else None, None if i % 37 == 0 else rng.randint(0, 3000), i) for i in range(6000)]
    hits = spark.createDataFrame(rows, "key string, s long, seq long").withColumn("counter_", F.lit(1))
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = windows.fixed_window_hits(hits, "key", F.col("s") * 1_000_000, ttl, "seq")
        got = {r["seq"]: r["counter"] for r in out.collect()}
        parts = out.filter("key = 'busy'").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(parts) > 8 and max(p["count"] for p in parts) < 600
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: r[1:])
        want |= dict(zip([r[2] for r in own], naive([r[1] for r in own], ttl), strict=True))
        want |= {r[2]: i + 1 for i, r in enumerate(r for r in rows if r[0] == key and r[1] is None)}
    assert got == want


def test_no_hits(spark):
    assert windows.fixed_window_hits(spark.createDataFrame([], "key long, s long, seq long"), "key", F.col("s"), 5, "seq").collect() == []
