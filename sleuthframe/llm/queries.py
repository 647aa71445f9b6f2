"""The registered queries opN_<name> and pipeline, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, durable, htmlextract, jaccard, licenses, mixing, quality, secrets, suffixdedup, tokencount, tokenfiles, urlfilter, variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.known(spark))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract(_table(spark, sf_dir, "pages"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = urlfilter.evaluate(urlfilter.captures_of(pages), urlfilter.entries_table(spark).unionByName(urlfilter.listed(pages)))
    return found.withColumn("fetched", F.col("fetched").cast("string"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In training order; ``position`` is the place of the first epoch, those of later ones follow."""
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    places = [F.round(F.get("places", F.lit(e))["position"], 9).alias(name) for e, name in enumerate(("position", "position_2", "position_3"))]
    return plan.select("doc_id", "size", "source_size", "target", "taken", "epochs", *places).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(_table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = durable.folder(spark, "token-files")
    tokenfiles.write(_table(spark, sf_dir, "documents"), path)
    return tokenfiles.checksums(spark, path)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_html_extraction": op3_html_extraction,
    "op4_url_filter": op4_url_filter,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontamination": op6_decontamination,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_secret_scan": op8_secret_scan,
    "op9_source_mixing": op9_source_mixing,
    "op10_token_counts": op10_token_counts,
    "op11_token_files": op11_token_files,
    "op12_collocations": op12_collocations,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {
    "op2_license_scan": licenses.scan_sql(),
    "op4_url_filter": urlfilter.evaluate_sql(),
    "op9_source_mixing": mixing.mix_sql(),
    "op12_collocations": collocations.mine_sql(),
    "op13_spelling_variants": variants.group_sql(),
}
