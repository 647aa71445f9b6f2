"""Timelines: one ordered view over events, artifacts and indicators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENVELOPE = "source_file string, seq long, ts_raw string, ts timestamp_ntz, event_code int, event_tag string, severity string, message string, host string, process string, pid string, provider string, data map<string,string>, parser string"


def merge(parts: Mapping[str, DataFrame]) -> DataFrame:
    """(ts_raw, event, severity, source) of several tables, labelled with their source."""
    out = None
    for source, df in parts.items():
        rows = df.select("ts_raw", "event", "severity", F.lit(source).alias("source"))
        out = rows if out is None else out.unionByName(rows)
    return out


def ordered(timeline: DataFrame, *tiebreak: Column | str) -> DataFrame:
    """By the timestamp's text, as stored; missing ones first."""
    return timeline.orderBy(F.coalesce("ts_raw", F.lit("")), *tiebreak)


def build(envelopes: DataFrame) -> DataFrame:
    """Timeline rows of parsed events."""
    return envelopes.select("ts_raw", F.left(F.coalesce("message", F.lit("")), F.lit(200)).alias("event"), F.coalesce("severity", F.lit("info")).alias("severity"), F.coalesce("event_tag", "parser").alias("source"))


def correlate(left: DataFrame, right: DataFrame, key: str, at: str, window_seconds: int) -> DataFrame:
    """Pairs of equal key whose right side comes within the window after the left one (``at``: seconds).

    An extension.  Time is cut into window-long bins and the left side goes to its own and the
    next bin, so it is an equi-join with a bounded residual instead of a range join.
    """
    bin_of = lambda c: F.floor(c / window_seconds)
    a = left.select(F.col(key), F.col(at).alias("left_at"), F.struct(*left.columns).alias("left"), F.explode(F.array(bin_of(F.col(at)), bin_of(F.col(at)) + 1)).alias("bin"))
    b = right.select(F.col(key), F.col(at).alias("right_at"), F.struct(*right.columns).alias("right"), bin_of(F.col(at)).alias("bin"))
    return a.join(b, [key, "bin"]).filter((F.col("right_at") >= F.col("left_at")) & (F.col("right_at") < F.col("left_at") + window_seconds)).drop("bin")
