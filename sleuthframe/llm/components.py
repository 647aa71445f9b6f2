"""Connected components of a link table, without collecting links or labels to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import Scratch


#: Most edges that one task may finish: its table of parents stays within some 100 MB.
SMALL = 250_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges (node, smallest node) of the components of one partition's links, in bounded memory."""
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    def edges() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 2_000_000:
            yield edges()
            parent.clear()
    yield edges()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a binary, b binary); root is the component's smallest node.

    Each partition first reduces its links to a forest, so a dense group costs no more than
    its nodes.  Then alternate large-star and small-star steps (Kiveris et al. 2014) run
    until nothing changes: O(log n) shuffles of at most a row a node, each written to the
    shared folder.  Once no more than ``SMALL`` edges are left one task finishes them, with the
    same result.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.write(links.select("a", "b").filter("a <> b").mapInArrow(_forest, "a binary, b binary").distinct(), "edges")
    # The same rows, by number and sum of hashes: nothing has changed.
    summary = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    last = summary(edges)
    while last[0]:
        if last[0] <= SMALL:
            stars = scratch.write(edges.coalesce(1).mapInArrow(_forest, "a binary, b binary"), "edges")
            scratch.keep(stars)
            edges = stars
            break
        # Large star: each node links its larger neighbours to its smallest one.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that Spark can split the join at the centre of a large star.
        least = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "least")
        large = both.join(least, both["a"] == least["n"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node links its smaller neighbours to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(low, large["a"] == low["n"]).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        after = scratch.write(small, "edges")
        now = summary(after)
        scratch.keep(after)
        edges, settled, last = after, now == last, now
        if settled:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
