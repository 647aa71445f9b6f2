"""Threat-intelligence connectors as enrichment of indicator tables.

The engine makes no network calls: a connector is a function from indicators and a snapshot
of the service's answers (a table) to enriched indicators, found by name in a registry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed


@dataclass(frozen=True)
class Connector:
    name: str
    types: dict[str, str]
    enrich: Callable[[DataFrame, DataFrame], DataFrame]
    pull: Callable[[DataFrame, int], DataFrame] | None = None

    def capabilities(self) -> list[str]:
        return ["enrich", *(["pull"] if self.pull else [])]


REGISTRY: dict[str, Connector] = {}


def connector(name: str, types: dict[str, str], pull=None):
    def register(fn):
        REGISTRY[name] = Connector(name, types, fn, pull)
        return fn

    return register


def vendor_type(iocs: DataFrame, name: str) -> DataFrame:
    """Indicators of types that a vendor knows, with its name of the type."""
    return iocs.withColumn("vendor_type", C.lookup(F.col("type"), REGISTRY[name].types)).filter("vendor_type is not null")


def _answers(iocs: DataFrame, name: str, answers: DataFrame) -> DataFrame:
    return vendor_type(iocs, name).join(answers.withColumnRenamed("value", "__v"), F.col("value") == F.col("__v"), "left").drop("__v")


def pull_misp(feed: DataFrame, limit: int) -> DataFrame:
    """(type, value, source) of a feed; the limit counts before unknown types go."""
    back = {v: k for k, v in fixed.MISP_TYPES.items()}
    return feed.orderBy("seq").limit(limit).select(C.lookup(F.col("type"), back).alias("type"), "value", F.lit("misp").alias("source")).filter("type is not null")


def pull_threatfox(feed: DataFrame, limit: int) -> DataFrame:
    back = {v: k for k, v in fixed.THREATFOX_TYPES.items()}
    return feed.orderBy("seq").limit(limit).select(C.lookup(F.col("type"), back).alias("type"), "value", F.lit("threatfox").alias("source"), C.threatfox_severity(F.col("confidence_level")).alias("severity")).filter("type is not null")


def pull_otx(feed: DataFrame, limit: int) -> DataFrame:
    back = {"IPv4": "ip", "domain": "domain", "hostname": "domain", "URL": "url", "email": "email", "CVE": "cve", "FileHash-MD5": "hash_md5", "FileHash-SHA1": "hash_sha1", "FileHash-SHA256": "hash_sha256"}
    known = feed.select("seq", C.lookup(F.col("type"), back).alias("type"), "value", F.lit("otx").alias("source")).filter("type is not null")
    return known.orderBy("seq").limit(limit).drop("seq")


def pull_malwarebazaar(feed: DataFrame, limit: int) -> DataFrame:
    return feed.orderBy("seq").limit(limit).select(F.lit("hash_sha256").alias("type"), "value", F.lit("malwarebazaar").alias("source"), F.lit("high").alias("severity"))


@connector("virustotal", fixed.VIRUSTOTAL_TYPES)
def virustotal(iocs: DataFrame, answers: DataFrame) -> DataFrame:
    """answers (value, malicious): malicious engines, 0 for what the service doesn't know, and the URL identifier."""
    out = _answers(iocs, "virustotal", answers).withColumn("malicious", F.coalesce("malicious", F.lit(0)))
    return out.withColumn("lookup_id", F.when(F.col("type") == "url", C.url_id(F.col("value"))).otherwise(F.col("value")))


@connector("threatfox", fixed.THREATFOX_TYPES, pull_threatfox)
def threatfox(iocs: DataFrame, answers: DataFrame) -> DataFrame:
    """answers (value, confidence_level, first_seen, malware): highest confidence, first sight and families of each indicator."""
    sums = answers.groupBy("value").agg(F.max("confidence_level").alias("confidence_level"), F.min("first_seen").alias("first_seen"), F.array_sort(F.collect_set("malware")).alias("families"))
    return _answers(iocs, "threatfox", sums)


@connector("greynoise", {"ip": "ip"})
def greynoise(iocs: DataFrame, answers: DataFrame) -> DataFrame:
    """answers (value, classification, noise, riot): unknown addresses are neither noise nor known services."""
    out = _answers(iocs, "greynoise", answers).withColumn("classification", F.coalesce("classification", F.lit("unknown")))
    return out.na.fill(False, ["noise", "riot"]).withColumn("message", C.greynoise_message(F.col("classification"), F.col("noise")))


@connector("abuseipdb", {"ip": "ip"})
def abuseipdb(iocs: DataFrame, answers: DataFrame) -> DataFrame:
    return _answers(iocs, "abuseipdb", answers)


@connector("shodan", {"ip": "ip", "domain": "domain"})
def shodan(iocs: DataFrame, answers: DataFrame) -> DataFrame:
    """answers (value, ports, vulns): the first 20 vulnerabilities are kept."""
    return _answers(iocs, "shodan", answers).withColumn("vulns", F.slice("vulns", 1, 20))


@connector("otx", fixed.OTX_TYPES, pull_otx)
def otx(iocs: DataFrame, answers: DataFrame) -> DataFrame:
    """answers (value, pulses array<struct<name, tags>>): pulse count, the first five, distinct tags."""
    out = _answers(iocs, "otx", answers)
    return out.withColumn("pulse_count", F.coalesce(F.size("pulses"), F.lit(0))).withColumn("tags", F.array_distinct(F.flatten(F.transform("pulses", lambda p: p["tags"])))).withColumn("pulses", F.slice("pulses", 1, 5))


@connector("urlscan", {"url": "url", "domain": "domain", "ip": "ip"})
def urlscan(iocs: DataFrame, answers: DataFrame) -> DataFrame:
    """answers (value, url, malicious) with a row per scan: scans, malicious ones, five samples."""
    sums = answers.groupBy("value").agg(F.count("*").alias("scans"), F.count_if("malicious").alias("malicious"), F.slice(F.array_sort(F.collect_set("url")), 1, 5).alias("samples"))
    return _answers(iocs, "urlscan", sums).na.fill(0, ["scans", "malicious"])


@connector("malwarebazaar", {k: k for k in ("hash_md5", "hash_sha1", "hash_sha256")}, pull_malwarebazaar)
def malwarebazaar(iocs: DataFrame, answers: DataFrame) -> DataFrame:
    """answers (value, seq, family, file_name): the first sample of each hash."""
    first = answers.groupBy("value").agg(F.min_by(F.struct("family", "file_name"), "seq").alias("sample"))
    return _answers(iocs, "malwarebazaar", first)


@connector("urlhaus", {"url": "url", "domain": "host", "ip": "host", "hash_md5": "md5_hash", "hash_sha256": "sha256_hash"})
def urlhaus(iocs: DataFrame, answers: DataFrame) -> DataFrame:
    return _answers(iocs, "urlhaus", answers)


@connector("misp", fixed.MISP_TYPES, pull_misp)
def misp(iocs: DataFrame, answers: DataFrame) -> DataFrame:
    return _answers(iocs, "misp", answers)


@connector("cortex", fixed.CORTEX_TYPES)
def cortex(iocs: DataFrame, answers: DataFrame) -> DataFrame:
    return _answers(iocs, "cortex", answers)


def overlay_configs(names: DataFrame, saved: DataFrame) -> DataFrame:
    """Connectors with their saved settings, secrets masked; disabled and untested where none are saved."""
    out = names.join(saved, "connector_id", "left").withColumn("enabled", F.coalesce("enabled", F.lit(False)))
    secret = lambda k: k.rlike("(?i)key|token|password|secret")
    masked = F.transform_values(F.coalesce("config", F.create_map().cast("map<string,string>")), lambda k, v: F.when(secret(k), C.mask_secret(v)).otherwise(v))
    return out.withColumn("config", masked)
