"""Indicators of compromise: extraction, import accounting, insert-or-ignore, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed


def extract(df: DataFrame, text: str | Column, keys: Sequence[str] = (), types: Sequence[str] | None = None, distinct: bool = True) -> DataFrame:
    """(keys, type, value, source) of every indicator in a text column.

    One scan for candidates, and one generator for all families, whose patterns run over the
    candidates only (``columns.ioc_candidates``).  ``distinct`` folds repeats of a (keys, type,
    value); without it, spellings that differ in case stay apart as rows.
    """
    column = F.col(text) if isinstance(text, str) else text
    likely = df.select(*keys, C.ioc_candidates(column).alias("__c"))
    found = likely.select(*keys, F.explode(C.extract_iocs(F.col("__c"), types)).alias("__i")).select(*keys, "__i.type", "__i.value", F.lit(fixed.EXTRACTED).alias("source"))
    return found.distinct() if distinct else found


def classify(rows: DataFrame) -> DataFrame:
    """Rows (type, value, ...) with ``outcome``: valid, missing or bad_type."""
    return rows.withColumn("outcome", C.ioc_outcome(F.col("type"), F.col("value")))


def import_accounting(rows: DataFrame, existing: DataFrame, keys: Sequence[str] = ("type", "value"), order: str = "seq") -> DataFrame:
    """(outcome, n): imported, duplicate, missing, bad_type."""
    judged = classify(rows)
    fresh = insert_or_ignore(judged.filter("outcome = 'valid'"), existing, keys, order)
    counts = judged.groupBy("outcome").agg(F.count("*").alias("n"))
    imported = fresh.agg(F.count("*").alias("n"))
    # Of the valid rows, what isn't imported is a duplicate.
    duplicate = counts.filter("outcome = 'valid'").select(F.lit("duplicate").alias("outcome"), (F.col("n") - imported.scalar()).alias("n"))
    return counts.filter("outcome <> 'valid'").unionByName(imported.select(F.lit("imported").alias("outcome"), "n")).unionByName(duplicate).filter("n > 0")


def import_errors(rows: DataFrame, order: Sequence[str], most: int = 10) -> DataFrame:
    """(number, error): the first errors of an import, in the order of its rows: types that don't exist."""
    bad = classify(rows).filter("outcome = 'bad_type'").orderBy(*order).limit(most)
    return bad.select(F.row_number().over(Window.orderBy(*order)).alias("number"), F.concat(F.lit("Type invalide: "), "type").alias("error"))


def insert_or_ignore(rows: DataFrame, existing: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows whose key is new: of equal keys the first by ``order``, none that ``existing`` has."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__n = 1").drop("__n")
    return first.join(existing.select(*keys), list(keys), "left_anti")


def across_sources(found: DataFrame, source: str = "artifact", least: int = 2) -> DataFrame:
    """(type, value, sources): indicators seen in ``least`` or more sources."""
    return found.groupBy("type", "value").agg(F.count_distinct(source).alias("sources")).filter(F.col("sources") >= least)


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """(column, count), largest first; ties by name."""
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def of_events(events: DataFrame, mode: str = "cell", keys: Sequence[str] = ("source_file",), namespaces: bool = False) -> DataFrame:
    """Indicators of event envelopes (keys, type, value, source).

    ``cell`` looks at each data value by itself, at the message where there are none; ``joined`` at the values of a row
    joined with commas, so that a URL takes what follows it along.  Schema namespaces of
    event XML count only with ``namespaces``.
    """
    cells = F.coalesce(F.map_values("data"), F.array().cast("array<string>"))
    values = F.array_compact(F.when(F.size(cells) > 0, cells).otherwise(F.array("message")))
    text = F.explode(F.array_distinct(values)) if mode == "cell" else F.array_join(cells, ",")
    found = extract(events.select(*keys, text.alias("__text")), "__text", keys)
    return found if namespaces else found.filter(~F.col("value").contains("schemas.microsoft.com"))


def known_addresses(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Rows whose column is one of the known values (one column)."""
    return rows.join(known.select(F.col(known.columns[0]).alias("__known")), F.col(column) == F.col("__known"), "left_semi")
