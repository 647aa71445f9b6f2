"""Exports: CSV, STIX 2.1, Markdown, MISP attributes, JSON lines, Prometheus text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed

PRODUCER = "sleuthframe"
CSV_HEADER = ("Type", "Valeur", "Source", "Severite", "Date")


def ioc_csv(iocs: DataFrame) -> DataFrame:
    """The export's columns, ordered by type and value; write it with ``coalesce(1)`` and a header for one file."""
    return iocs.select(*[F.col(c).alias(n) for c, n in zip(("type", "value", "source", "severity", "created_at"), CSV_HEADER, strict=True)]).orderBy("Type", "Valeur")


def _indicator(investigation: str = "investigation_id") -> list[Column]:
    name = F.concat("type", F.lit(": "), "value")
    identity = F.concat(F.lit("indicator--"), C.uuid5_url(F.concat_ws(":", F.col(investigation), "type", "value")))
    labels = F.when(F.coalesce("severity", F.lit("unknown")) != "unknown", F.array(F.concat(F.lit("severity:"), "severity"))).otherwise(F.array().cast("array<string>"))
    return [F.col(investigation).alias("investigation_id"), identity.alias("id"), name.alias("name"), C.stix_pattern(F.col("type"), F.col("value")).alias("pattern"), C.confidence(F.col("severity")).alias("confidence"), labels.alias("labels")]


def stix_indicators(iocs: DataFrame, investigation: str = "investigation_id") -> DataFrame:
    """(investigation_id, id, name, pattern, confidence, labels) of indicators; pattern is null for types without one."""
    return iocs.select(*_indicator(investigation))


def stix_bundles(investigations: DataFrame, iocs: DataFrame, now: Column, producer: str = PRODUCER) -> DataFrame:
    """(investigation_id, bundle): a STIX 2.1 bundle as JSON for each investigation: identity, indicators, report.

    An indicator without a pattern is no object but stays among the report's references.
    """
    me = F.concat(F.lit("identity--"), C.uuid5_url(F.lit(producer)))
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.'000Z'")
    made = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    rows = iocs.select(*_indicator(), made(F.col("created_at")).alias("created"), F.coalesce("source", F.lit("N/A")).alias("source"))
    parent = investigations.select(F.col("id").alias("__p"), F.coalesce("name", "id").alias("__name"))
    rows = rows.join(parent, F.col("investigation_id") == F.col("__p"))
    text = F.to_json(
        F.struct(
            F.lit("indicator").alias("type"),
            F.lit("2.1").alias("spec_version"),
            "id",
            "created",
            F.col("created").alias("modified"),
            "name",
            F.concat(F.lit("IoC detecte dans l'enquete "), "__name", F.lit(". Source: "), "source").alias("description"),
            F.array(F.lit("malicious-activity")).alias("indicator_types"),
            "pattern",
            F.lit("stix").alias("pattern_type"),
            F.col("created").alias("valid_from"),
            "confidence",
            me.alias("created_by_ref"),
            F.when(F.size("labels") > 0, F.col("labels")).alias("labels"),
        )
    )
    grouped = rows.groupBy("investigation_id").agg(F.array_sort(F.collect_list(F.struct("name", F.col("id").alias("ref"), F.when(F.col("pattern").isNotNull(), text).alias("json")))).alias("all"))
    identity = F.to_json(F.struct(F.lit("identity").alias("type"), F.lit("2.1").alias("spec_version"), me.alias("id"), stamp.alias("created"), stamp.alias("modified"), F.lit(producer).alias("name"), F.lit("system").alias("identity_class")))
    joined = investigations.join(grouped, investigations["id"] == grouped["investigation_id"], "left").drop("investigation_id")
    refs = F.concat(F.array(me), F.coalesce(F.transform("all", lambda x: x["ref"]), F.array().cast("array<string>")))
    report = F.to_json(
        F.struct(
            F.lit("report").alias("type"),
            F.lit("2.1").alias("spec_version"),
            F.concat(F.lit("report--"), "id").alias("id"),
            F.coalesce(made(F.col("created_at")), stamp).alias("created"),
            F.coalesce(made(F.col("updated_at")), stamp).alias("modified"),
            F.coalesce("name", F.lit("Investigation")).alias("name"),
            F.coalesce("description", F.lit("")).alias("description"),
            F.array(F.lit("threat-report")).alias("report_types"),
            stamp.alias("published"),
            refs.alias("object_refs"),
            me.alias("created_by_ref"),
        )
    )
    objects = F.concat(F.array(identity), F.coalesce(F.filter(F.transform("all", lambda x: x["json"]), lambda j: j.isNotNull()), F.array().cast("array<string>")), F.array(report))
    bundle = F.concat(F.lit('{"type":"bundle","id":"bundle--'), C.uuid5_url(F.col("id")), F.lit('","objects":['), F.array_join(objects, ","), F.lit("]}"))
    return joined.select(F.col("id").alias("investigation_id"), bundle.alias("bundle"))


def misp_attributes(iocs: DataFrame) -> DataFrame:
    """(misp_type, value, category, to_ids, comment) of indicators that MISP has a type for."""
    network = F.col("type").isin("ip", "domain", "url")
    return iocs.select(
        C.lookup(F.col("type"), fixed.MISP_TYPES).alias("misp_type"),
        "value",
        F.when(network, F.lit("Network activity")).otherwise(F.lit("Payload delivery")).alias("category"),
        F.lit(True).alias("to_ids"),
        F.concat(F.lit("Source: "), F.coalesce("source", F.lit("unknown"))).alias("comment"),
    ).filter("misp_type is not null")


def case_report(investigations: DataFrame, artifacts: DataFrame, iocs: DataFrame, timeline: DataFrame, generated: Column) -> DataFrame:
    """(investigation_id, report): a Markdown report of each investigation."""

    def listed(df: DataFrame, line: Column, order: Sequence[Column | str], name: str) -> DataFrame:
        return df.groupBy(F.col("investigation_id").alias(f"__{name}")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]).alias(name))

    na = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    arts = listed(artifacts, F.concat(F.lit("- "), F.coalesce("original_filename", "filename", F.lit("N/A")), F.lit(" (SHA256: "), na("file_hash_sha256"), F.lit(")")), [F.col("id")], "arts")
    found = listed(iocs, F.concat(F.lit("- ["), na("type"), F.lit("] "), na("value"), F.lit(" (source: "), na("source"), F.lit(")")), [F.col("id")], "found")
    times = listed(timeline, F.concat(F.lit("- "), na("timestamp"), F.lit(" ["), F.coalesce("severity", F.lit("info")), F.lit("] "), na("event")), [F.coalesce("timestamp", F.lit("")).alias("t"), F.col("id")], "times")
    joined = investigations
    for df, name in ((arts, "arts"), (found, "found"), (times, "times")):
        joined = joined.join(df, F.col("id") == F.col(f"__{name}"), "left").drop(f"__{name}")

    def section(title: str, name: str) -> list[Column]:
        lines = F.coalesce(F.col(name), F.array().cast("array<string>"))
        return [F.concat(F.lit(f"\n## {title} ("), F.size(lines).cast("string"), F.lit(")")), F.when(F.size(lines) > 0, F.array_join(lines, "\n"))]

    head = [F.concat(F.lit("# Rapport d'Enquete: "), F.coalesce("name", F.lit("Sans nom"))), F.concat(F.lit("\nDate: "), F.date_format(generated, "yyyy-MM-dd HH:mm:ss")), F.concat(F.lit("Statut: "), na("status"))]
    report = F.concat_ws("\n", *head, *section("Artefacts", "arts"), *section("IoCs", "found"), *section("Timeline", "times"))
    return joined.select(F.col("id").alias("investigation_id"), report.alias("report"))


def findings_markdown(findings: DataFrame) -> DataFrame:
    """(case_id, markdown): the findings table, most severe first."""
    cell = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("|"), F.lit("\\|"))
    marks = {"verified": "verifie", "unverified": "non verifie", "refuted": "refute", "pending": "a verifier"}
    evidence = F.left(F.replace(F.replace(F.coalesce("evidence", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")), F.lit(160))
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    verification = C.lookup(F.coalesce("verification", F.lit("pending")), marks, F.lit("a verifier"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("id").cast("string"), "severity", "confidence", verification, cell("title"), dash(F.col("mitre")), dash(evidence)), F.lit(" |"))
    rows = findings.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(C.severity_rank(F.col("severity")).alias("rank"), F.col("id"), line.alias("line")))).alias("rows"))
    head = "## Constats (findings)\n\n| # | Severite | Confiance | Verification | Constat | MITRE | Preuve |\n|---|---|---|---|---|---|---|\n"
    return rows.select("case_id", F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("markdown"))


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON document a row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def _labelled(name: str, labels: Sequence[str]) -> Column:
    """``name{a="x",b="y"}``; backslashes, quotes and line ends of values are escaped."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    if not labels:
        return F.lit(name)
    return F.concat(F.lit(name + "{"), F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels]), F.lit("}"))


def prometheus_counter(rows: DataFrame, name: str, help_text: str, labels: Sequence[str] = (), kind: str = "counter") -> DataFrame:
    """Text lines of a Prometheus counter of rows by their labels, or of a gauge; without labels one line, 0 for no rows."""
    counts = rows.groupBy(*labels).agg(F.count("*").alias("__n"))
    head = rows.sparkSession.createDataFrame([(f"# HELP {name} {help_text}",), (f"# TYPE {name} {kind}",)], "line string")
    return head.unionByName(counts.select(F.concat(_labelled(name, labels), F.lit(" "), F.col("__n").cast("string")).alias("line")))


def session_json(iocs: DataFrame) -> DataFrame:
    """(id, session): the session document of each case, its indicators as sorted lists under the old keys; other types are left out."""
    old = {new: key for key, new in fixed.SESSION_KEYS.items()}
    named = iocs.withColumn("__key", C.lookup(F.col("type"), old)).filter("__key is not null and value is not null")
    lists = named.groupBy("investigation_id", "__key").agg(F.array_sort(F.collect_set("value")).alias("values"))
    cases = lists.groupBy("investigation_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__key", "values")))).alias("iocs"))
    return cases.select(F.col("investigation_id").alias("id"), F.to_json(F.struct("iocs")).alias("session"))


def prometheus_histogram(values: DataFrame, column: str, name: str, bounds: Sequence[float] = fixed.LATENCY_BUCKETS) -> DataFrame:
    """Text lines of a Prometheus histogram."""
    from .windows import cumulative_buckets

    buckets = cumulative_buckets(values, column, bounds).select(F.concat(F.lit(f'{name}_bucket{{le="'), "le", F.lit('"} '), F.col("n").cast("string")).alias("line"))
    totals = values.agg(F.sum(column).alias("s"), F.count(column).alias("n"))
    rest = totals.select(F.explode(F.array(F.concat(F.lit(f"{name}_sum "), F.coalesce("s", F.lit(0.0)).cast("string")), F.concat(F.lit(f"{name}_count "), F.col("n").cast("string")))).alias("line"))
    return buckets.unionByName(rest)
