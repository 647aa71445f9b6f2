"""Dashboards: overview counts, daily series, top-k."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed


def overview(investigations: DataFrame, others: Mapping[str, DataFrame]) -> DataFrame:
    """One row: investigations by status and rows of the other tables, each a scalar subquery of one partial aggregate."""
    by_status = [F.count_if(F.col("status") == s).alias(f"investigations_{s}") for s in fixed.STATUSES]
    out = investigations.agg(F.count("*").alias("investigations"), *by_status)
    return out.withColumns({name: df.agg(F.count("*")).scalar() for name, df in others.items()})


def daily(rows: DataFrame, at: str, last_day: Column, days: int = 7) -> DataFrame:
    """(day, n) of rows in the last ``days`` days that end with ``last_day``."""
    return rows.filter((F.col(at) >= F.date_sub(last_day, days - 1)) & (F.col(at) < F.date_add(last_day, 1))).groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))


def dense_series(spark_day: DataFrame, series: Mapping[str, DataFrame], days: int = 7) -> DataFrame:
    """One row for each of the last days (``spark_day`` is one row with ``last_day``), a column for each series, 0 where it has none."""
    out = spark_day.select(F.explode(F.sequence(F.date_sub("last_day", days - 1), F.col("last_day"))).alias("day"))
    for name, df in series.items():
        out = out.join(df.select("day", F.col("n").alias(name)), "day", "left")
    return out.na.fill(0, list(series))


def top_hosts(visits: DataFrame, url: str = "url", k: int = 10) -> DataFrame:
    """(host, visits): hosts with most visits; ties by name."""
    return visits.select(C.url_host(F.col(url)).alias("host")).filter("host is not null").groupBy("host").agg(F.count("*").alias("visits")).orderBy(F.desc("visits"), "host").limit(k)


def event_counts(events: DataFrame, k: int = 20, code: str = "event_code", order: str = "seq") -> DataFrame:
    """(event_code, n, description): most frequent codes, ties in order of first sight, with their names."""
    counts = events.groupBy(code).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(k)
    return counts.select(code, "n", C.lookup(F.col(code).cast("int"), fixed.EVENT_NAMES, F.lit("")).alias("description"))


def suspicious_counts(events: DataFrame, code: str = "event_code") -> DataFrame:
    """(event_code, n) of codes worth a look."""
    return events.filter(F.col(code).isin(*fixed.SUSPICIOUS_EVENTS)).groupBy(code).agg(F.count("*").alias("n"))


def loops(calls: DataFrame, signature: str = "signature", limit: int = 3) -> DataFrame:
    """Call signatures repeated ``limit`` times or more."""
    return calls.groupBy(signature).agg(F.count("*").alias("n")).filter(F.col("n") >= limit)


def folder_size(inventory: DataFrame, size: str = "size_bytes") -> DataFrame:
    """(files, size_bytes) of a listing."""
    return inventory.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("size_bytes"))


def running_jobs(jobs: DataFrame, status: str = "status") -> DataFrame:
    """(jobs, jobs_running) of a job table."""
    return jobs.agg(F.count("*").alias("jobs"), F.count(F.when(F.col(status) == "running", 1)).alias("jobs_running"))


def token_usage(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls and sums of their token counts, by key; a missing count is 0."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), *sums)
