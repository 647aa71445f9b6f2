"""Mixing sources to target weights: a time-varying curriculum (native: DataFrame functions only).

Each source has a weight *schedule*, piecewise linear over training time 0..1.  Its
integral, scaled to the source's target, is the source's cumulative token demand; the
inverse of that function gives the training time at which the c-th word of the source is
wanted.  A document takes the words [c, c + size) of its source's shuffled order, again
in each epoch, so its training position is the inverse at c, and that of a later epoch the
inverse at c plus whole sources; range-sorting all documents by position, once for each
epoch that they are in, gives the mixed order.

Scale: one pass counts the words; what follows reads only (doc_id, source, size).  Offsets are two-level: totals of
(source, bucket) are summed over the few thousand buckets of a source, and documents are
numbered inside one bucket, so a source with a third of all rows is spread over
thousands of groups.  No text is shuffled unless the caller asks for the ordered texts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import materialize

#: Documents of a source are dealt over 16**DIGITS buckets by the first digits of their hash; raise it where a bucket's rows are too many for a task.
DIGITS = 3
#: Knots (time, relative weight) of the schedules, by weight class: rare sources early, heavy ones late.
SCHEDULES: dict[int, Sequence[tuple[float, float]]] = {
    1: ((0.0, 1.5), (1.0, 0.5)),
    2: ((0.0, 1.0), (1.0, 1.0)),
    3: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
}


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text, null: 0.

    Runs of word characters shrink to one character each and separators go, all in the JVM.
    """
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w"), r"[\x20\x09-\x0D]+", "")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, size).

    Sources in code-point order, null last, take ``weights`` in turn.  Shares of the total
    are in proportion to weight; none is above ``cap`` times its source and the excess goes
    to the others by weight, which is filling vessels with water: sources in order of
    cap / weight fill up first, the rest share evenly: the level is that of the first one that
    it doesn't overflow, and levels only fall after it.  Sums are of integers, so any
    order of rows gives the same doubles.  Sources of size 0 get 0.

    Filling looks at all sources together: the windows run in one task over a row a source,
    of which a corpus has few; rows of ``sizes`` are summed before that.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("full") / F.col("weight"), F.col("turn"))
    everything = Window.partitionBy(F.lit(0))
    turns = F.array(*[F.lit(int(w)) for w in weights])
    table = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("turn", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(turns, (F.col("turn") % len(weights) + 1).cast("int")))
        .withColumn("full", F.col("source_size") * cap)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("before", F.sum("full").over(by_level) - F.col("full"))
        .withColumn("rest", F.sum("weight").over(everything) - F.sum("weight").over(by_level) + F.col("weight"))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.col("level"))).over(everything))
    )
    target = F.least(F.col("full").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return table.select("source", "source_size", "weight", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def _segments(knots: Sequence[tuple[float, float]]) -> Column:
    """Schedule as array<struct(t, w, slope, cum, mass)>, cum and mass as shares of the whole integral."""
    parts, cum = [], 0.0
    area = sum((u[0] - t[0]) * (t[1] + u[1]) / 2 for t, u in zip(knots, knots[1:], strict=False))
    for (t, w), (u, v) in zip(knots, knots[1:], strict=False):
        mass = (u - t) * (w + v) / 2 / area
        parts.append(F.struct(*[F.lit(float(x)).alias(n) for n, x in (("t", t), ("w", w / area), ("slope", (v - w) / (u - t) / area), ("cum", cum), ("mass", mass))]))
        cum += mass
    return F.array(*parts)


def inverse_demand(schedule: Column, share: Column) -> Column:
    """Training time at which the cumulative demand reaches ``share`` (0..1) of the whole.

    Inside a segment the demand is cum + w*d + slope*d*d/2; the root is written so that it
    neither divides by a slope of 0 nor cancels.
    """
    piece = F.element_at(F.filter(schedule, lambda s: s["cum"] <= share), -1)
    ahead = share - piece["cum"]
    root = F.sqrt(F.greatest(piece["w"] * piece["w"] + 2 * piece["slope"] * ahead, F.lit(0.0)))
    below = piece["w"] + root
    return piece["t"] + F.when(below > 0, 2 * ahead / below).otherwise(0.0)


def mix_plan(docs: DataFrame, keys: Sequence[str] = ("doc_id",), weights: Sequence[int] = (1, 2, 3), cap: int = 3, schedules: Mapping[int, Sequence[tuple[float, float]]] = SCHEDULES, digits: int = DIGITS, seed: int = 17, size: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``keys``, size, source, source_size, target, taken, epochs, position, places.

    ``taken`` is the number of words that the mix takes from the document, repeats counted:
    whole epochs, and of the last one only the words before the source's target, so a
    source's ``taken`` sums to its target less than one word.  ``places`` holds the training
    time (0..1) of the document's first word in each of its epochs and the words that the
    epoch takes; ``position`` is the first one's time, null if it takes none.  Order inside a source is by a
    seeded hash of the keys, then the size, so reruns agree; equal rows are
    interchangeable.  Null text: size 0, taken 0.  Null source: a source of its own, last.
    An empty table gives no rows.  Columns of ``docs`` other than keys and source don't matter.
    """
    # Sizes are counted once: the three steps below read this narrow table, not the texts.
    base = materialize(docs.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("source"), (word_count(F.col("text")) if size is None else size).alias("size")), "sizes")
    names = [f"__k{i}" for i in range(len(keys))]
    # A key that is never null, so that the window's partitioning also serves the join.
    shuffled = base.withColumn("__s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("__h", F.md5(F.concat_ws(":", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names], F.lit(str(seed))))).withColumn("__b", F.substring("__h", 1, digits))
    totals = shuffled.groupBy("__s", "__b").agg(F.first("source").alias("source"), F.sum("size").alias("size"))
    targets = source_targets(totals, weights, cap)
    ahead = Window.partitionBy("__s").orderBy("__b")
    start = totals.withColumn("__start", F.sum("size").over(ahead) - F.col("size")).select("__s", "__b", "__start")
    inside = Window.partitionBy("__s", "__b").orderBy("__h", "size")
    numbered = shuffled.withColumn("__c", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    targets = targets.withColumn("__s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    placed = numbered.join(start.join(targets, "__s"), ["__s", "__b"])
    at = F.col("__start") + F.col("__c")
    whole = F.floor(F.col("target")).cast("long")
    once = lambda e: F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), whole - at - F.col("source_size") * e))
    schedule = F.coalesce(*[F.when(F.col("weight") == w, _segments(k)) for w, k in schedules.items()], _segments(((0.0, 1.0), (1.0, 1.0))))
    taken = sum((once(e) for e in range(1, cap)), once(0))
    place = lambda e: F.struct(inverse_demand(schedule, (at + F.col("source_size") * e) / F.col("target")).alias("position"), once(e).alias("taken"))
    return (
        placed.withColumn("taken", taken)
        .withColumn("epochs", F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("long"))
        .withColumn("places", F.when(F.col("taken") > 0, F.filter(F.array(*[place(e) for e in range(cap)]), lambda p: p["taken"] > 0)))
        .select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "size", "source", "source_size", "target", "taken", "epochs", F.col("places")[0]["position"].alias("position"), "places")
    )


def mix_documents(docs: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` that it takes, once for each epoch, range-sorted by training position.

    All columns of ``docs`` stay; ``mix_size``, ``mix_target``, ``mix_taken``, ``mix_epoch``
    and ``mix_position`` come after them (a column of ``docs`` of such a name is replaced).
    A document that repeats stands at its place in each epoch (``mix_epoch`` counts from 1),
    where ``mix_taken`` of its words are taken: all of them but in the last one of a source.
    Documents that the mix takes nothing of are absent.
    """
    added = ("size", "target", "taken", "epoch", "position")
    docs = docs.drop(*[f"mix_{c}" for c in added])
    row = F.md5(F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.coalesce(F.col("source"), F.lit("\x00")), F.coalesce("text", F.lit("\x00"))))
    keyed = docs.withColumn("__row", row)
    plan = mix_plan(keyed.select("__row", "source", "text"), keys=("__row",), **options)
    plan = plan.filter("taken > 0").select(F.col("__row").alias("__key"), *[F.col(c).alias(f"mix_{c}") for c in ("size", "target", "position")], F.col("places").alias("__places"))
    # Equal rows share a key: the n-th of them takes the n-th of their plans.
    nth = lambda df, key, order: df.withColumn(f"{key}_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    mixed = nth(keyed, "__row", F.lit(1)).join(nth(plan, "__key", F.col("mix_position")), (F.col("__row") == F.col("__key")) & (F.col("__row_n") == F.col("__key_n")))
    mixed = mixed.select(*docs.columns, "mix_size", "mix_target", F.posexplode("__places").alias("__e", "__place"))
    mixed = mixed.select(*docs.columns, "mix_size", "mix_target", F.col("__place.taken").alias("mix_taken"), (F.col("__e") + 1).alias("mix_epoch"), F.col("__place.position").alias("mix_position"))
    order = [F.col("mix_position"), F.col("doc_id"), F.col("mix_epoch")]
    ranged = mixed.repartitionByRange(partitions, *order) if partitions else mixed.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def mix_sql(seed: int = 17) -> str:
    """``mix_plan`` of documents with weights 1, 2, 3 and cap 3, for DuckDB (positions of the epochs rounded to 9 places)."""
    count = r"length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g'))"
    once = "greatest(0, least(size, CAST(floor(target) AS BIGINT) - word_at - source_size * {e}))"
    pieces = []
    for w, knots in SCHEDULES.items():
        area = sum((u[0] - t[0]) * (t[1] + u[1]) / 2 for t, u in zip(knots, knots[1:], strict=False))
        cum, ends = 0.0, []
        for (t, a), (u, b) in zip(knots, knots[1:], strict=False):
            ends.append((cum, t, a / area, (b - a) / (u - t) / area))
            cum += (u - t) * (a + b) / 2 / area
        for c, t, a, m in reversed(ends):
            pieces.append(f"WHEN weight = {w} AND SHARE >= {c!r} THEN {t!r} + 2 * (SHARE - {c!r}) / ({a!r} + sqrt({a!r} * {a!r} + 2 * {m!r} * (SHARE - {c!r})))")
    places = ", ".join(f"CASE WHEN {once.format(e=e)} > 0 THEN round(CASE {' '.join(pieces)} END, 9) END AS {name}".replace("SHARE", f"((word_at + source_size * {e}) / target)") for e, name in enumerate(("position", "position_2", "position_3")))
    return f"""
    WITH d AS (SELECT doc_id, source, CAST({count} AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{seed}') AS h FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    n AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight, 3 * source_size AS full_size FROM s),
    l AS (SELECT *, CAST(sum(source_size) OVER () - sum(full_size) OVER o + full_size AS DOUBLE) / CAST(sum(weight) OVER () - sum(weight) OVER o + weight AS DOUBLE) AS level
          FROM n WINDOW o AS (ORDER BY full_size / weight, source IS NULL, encode(source))),
    t AS (SELECT source, source_size, weight, CASE WHEN source_size > 0 THEN least(CAST(full_size AS DOUBLE), coalesce(max(CASE WHEN level * weight <= full_size THEN level END) OVER (), 0) * weight) ELSE 0.0 END AS target FROM l),
    p AS (SELECT doc_id, size, source_size, weight, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS word_at FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    k AS (SELECT *, {" + ".join(once.format(e=e) for e in range(3))} AS taken FROM p)
    SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, CAST(CASE WHEN size > 0 THEN ceil(taken / size) ELSE 0 END AS BIGINT) AS epochs,
           {places} FROM k"""
