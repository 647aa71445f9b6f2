"""A corpus pipeline: quality rules, near duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result
as Parquet to the shared folder and reads it again as the next one's docs.  All stages but
the last return the columns of ``docs``; the last returns the mix, with its columns after those.
Nulls, ties, repeated rows and odd texts have the result that the operator of the stage
states; an empty table gives an empty one.

Tables that the operators write belong to the DataFrames that read them.  ``run`` frees those
of a stage, and the result of the stage before, once its own result is written; a stage that
is called alone leaves its docs and all others usable, lazy or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sleuthframe.llm import decontam, durable, jaccard, mixing, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that hangs together by similarities of 0.8 or more."""
    return jaccard.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights, in training order."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]

#: Tokeniser bands, connected components and decoded secrets are beyond SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, all stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable.materialize(stage(spark, docs, sf_dir), name)
        durable.free(spark)
    return docs
