"""ATT&CK enrichment: dimension joins and roll-ups; the dimensions have a fixed small size and are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed


def event_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.EVENT_TO_ATTACK), "dim_code int, tactic string, technique string, technique_name string")


def ioc_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.IOC_TO_ATTACK), "type string, tactic string, technique string, technique_name string")


def enrich_events(events: DataFrame, code: str = "event_code") -> DataFrame:
    """Events with ``attack``: array of structs, empty for unknown codes, null for a null or zero code."""
    dim = F.broadcast(event_dimension(events.sparkSession))
    hit = F.struct("tactic", "technique", "technique_name")
    none = F.array().cast("array<struct<tactic:string,technique:string,technique_name:string>>")
    attack = F.when(F.coalesce(F.col(code), F.lit(0)) == 0, F.lit(None)).when(F.col("dim_code").isNull(), none).otherwise(F.array(hit))
    return events.join(dim, F.col(code) == F.col("dim_code"), "left").withColumn("attack", attack).drop("dim_code", "tactic", "technique", "technique_name")


def summary(events: DataFrame, code: str = "event_code", order: str = "seq") -> DataFrame:
    """(tactic, techniques): distinct ``technique: name`` of a tactic in order of first sight.

    Codes are counted down to one row each before the join, so the window sees dimension rows only.
    """
    seen = events.groupBy(F.col(code).alias("dim_code")).agg(F.min(order).alias("first"))
    label = F.concat("technique", F.lit(": "), "technique_name")
    named = seen.join(F.broadcast(event_dimension(events.sparkSession)), "dim_code").groupBy("tactic", label.alias("label")).agg(F.min("first").alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", "label")))
    return named.groupBy("tactic").agg(F.transform(listed, lambda x: x["label"]).alias("techniques"))


def ioc_rollup(iocs: DataFrame) -> DataFrame:
    """(tactic, technique, technique_name, indicators): how many indicators of mapped types point at each technique."""
    counts = iocs.groupBy("type").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(ioc_dimension(iocs.sparkSession)), "type").groupBy("tactic", "technique", "technique_name").agg(F.sum("n").alias("indicators"))


def ioc_links(iocs: DataFrame) -> DataFrame:
    """(tactic, technique, technique_name, type, value): an indicator for each technique that its type points at."""
    return iocs.join(F.broadcast(ioc_dimension(iocs.sparkSession)), "type").select("tactic", "technique", "technique_name", "type", "value")


def ioc_matrix(iocs: DataFrame, most: int | None = None) -> DataFrame:
    """(tactic, technique, technique_name, indicators): the values of ``ioc_links`` listed in one row, for display.

    ``most`` keeps the first of each technique; without it a row is as long as the technique has indicators.
    """
    joined = ioc_links(iocs)
    if most:
        joined = joined.withColumn("__n", F.row_number().over(Window.partitionBy("technique", "tactic").orderBy("type", "value"))).filter(F.col("__n") <= most)
    return joined.groupBy("tactic", "technique", "technique_name").agg(F.array_sort(F.collect_list(F.struct("type", "value"))).alias("indicators"))
