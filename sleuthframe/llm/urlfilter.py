"""URL filters: a temporal list join.

Block lists change: an entry is added on one date, removed on another, added again.  Dated
entries become validity intervals, and an as-of join evaluates every capture against the
entries that were active when it was fetched, not against today's list.

Plan: only distinct hosts meet the list (a host with a third of all captures is one row
there); the intervals of all list entries that cover a host are packed into one row of a
host dimension, so the join back to captures adds no rows, and the as-of test is a filter
over that small array.  The dimension is written, and broadcast if a count shows that it is
small; otherwise it is a shuffle join of two plain tables, in which adaptive execution splits
hot hosts.

Lists are tables (``read_entries``).  No dated public list comes with the pages, so the
registered query's list is ``ENTRIES`` and entries that a rule derives from the pages' own
hosts and addresses (``listed``): it grows with the data as a real list does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .durable import materialize

#: Rows of a dimension that may be broadcast; their intervals are counted too.
BROADCAST_ROWS = 100_000
_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_ADDRESS = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^?#]*)"

#: A dated block list: scope, pattern, category, active from the date on or no longer, date.
ENTRIES: tuple[tuple[str, str, str, bool, str], ...] = (
    ("domain", "spam-farm.example.org", "spam", True, "2023-11-01"),
    ("domain", "spam-farm.example.org", "spam", False, "2024-04-15"),
    ("domain", "spam-farm.example.org", "spam", True, "2024-08-01"),
    ("domain", "cheap-pills.example.com", "pharma", True, "2024-02-10"),
    ("domain", "cheap-pills.example.com", "spam", True, "2024-01-05"),
    ("domain", "cheap-pills.example.com", "spam", False, "2024-10-01"),
    ("domain", "ththre.example.com", "phishing", True, "2024-06-01"),
    ("domain", "ththre.example.com", "phishing", False, "2024-06-30"),
    ("domain", "therin.example.net", "malware", True, "2024-03-01"),
    ("url", "therha.example.com/en/676", "phishing", True, "2024-01-01"),
    ("url", "ththin.example.com/en/671", "malware", True, "2024-09-01"),
)
#: The pages carry no fetch time: the query spreads them over this year by page_id.
FIRST_DAY, DAYS = "2024-01-01", 366
#: Of hosts, those whose digest starts with one of these are on the query's list for a time; of addresses likewise.
LISTED_HOSTS, LISTED_ADDRESSES = ("0", "1", "2"), ("000", "7ff", "a5a")
CATEGORIES = ("adult", "malware", "phishing", "spam")


def host(url: Column) -> Column:
    """Lower-case host without port and final dot; empty if the address has none or is null."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), _HOST, 1), r"\.$", "")


def address(url: Column) -> Column:
    """Lower-case host and path, without scheme, query, fragment and final slashes."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), _ADDRESS, 1), r"/+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """(scope, pattern, category, valid_from, valid_to) of active times, end exclusive, null: open.

    Of entries for the same day a removal wins.  An entry with a null pattern, category,
    state or date counts for nothing.
    """
    known = entries.select("scope", F.lower("pattern").alias("pattern"), "category", "active", "since").dropna()
    after = Window.partitionBy("scope", "pattern", "category").orderBy("since", F.col("active").desc())
    return known.withColumn("valid_to", F.lead("since").over(after)).filter("active and (valid_to is null or since < valid_to)").select("scope", "pattern", "category", F.col("since").alias("valid_from"), "valid_to")


def _small(df: DataFrame, name: str) -> DataFrame:
    """``df``, written, with a broadcast hint if a count shows it is under the bound."""
    df = materialize(df, name)
    size = df.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    return F.broadcast(df) if max(size) <= BROADCAST_ROWS else df


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, host, fetched, categories, blocked) for each row of ``captures`` (page_id, url, fetched).

    ``categories`` are the comma-joined sorted categories of entries active at ``fetched``: of a
    domain entry for the host or one of its parent domains, or of a url entry for the exact
    host and path.  A null url or fetch time matches nothing.  Repeated captures each get
    their row; other columns are not read.
    """
    spans = intervals(entries)
    span = F.struct("category", "valid_from", "valid_to")
    rows = captures.select("page_id", "fetched", host(F.col("url")).alias("host"), address(F.col("url")).alias("__a"))
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select("host").filter("host <> ''").distinct().withColumn("pattern", F.explode(tails))
    domains = spans.filter("scope = 'domain'").drop("scope").groupBy("pattern").agg(F.collect_list(span).alias("spans"))
    by_host = hosts.join(_small(domains, "listed-domains"), "pattern").groupBy("host").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    by_address = spans.filter("scope = 'url'").groupBy(F.regexp_replace("pattern", "/+$", "").alias("__a")).agg(F.collect_list(span).alias("spans"))
    joined = rows.join(_small(by_host, "listed-hosts").withColumnRenamed("spans", "__h"), "host", "left").join(_small(by_address, "listed-addresses").withColumnRenamed("spans", "__u"), "__a", "left")
    none = F.array().cast("array<struct<category:string,valid_from:date,valid_to:date>>")
    every = F.concat(F.coalesce("__h", none), F.coalesce("__u", none))
    active = F.filter(every, lambda s: (s["valid_from"] <= F.col("fetched")) & (s["valid_to"].isNull() | (F.col("fetched") < s["valid_to"])))
    categories = F.array_join(F.array_sort(F.array_distinct(F.transform(active, lambda s: s["category"]))), ",")
    return joined.withColumn("categories", categories).select("page_id", "host", "fetched", "categories", (F.col("categories") != "").alias("blocked"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Dated entries (scope, pattern, category, active, since) of a CSV file with a header, or of a folder of Parquet."""
    schema = "scope string, pattern string, category string, active boolean, since date"
    return spark.read.csv(path, header=True, schema=schema) if path.endswith(".csv") else spark.read.schema(schema).parquet(path)


def listed(pages: DataFrame) -> DataFrame:
    """Entries by rule: of the hosts and addresses of ``pages`` those whose MD5 starts with a listed prefix.

    Digits of the digest give the category, the day of listing, and for every second one the
    days until it is removed.
    """
    hosts = pages.select(F.lit("domain").alias("scope"), host(F.col("url")).alias("pattern")).distinct().filter(F.substring(F.md5("pattern"), 1, 1).isin(*LISTED_HOSTS))
    addresses = pages.select(F.lit("url").alias("scope"), address(F.col("url")).alias("pattern")).distinct().filter(F.substring(F.md5("pattern"), 1, 3).isin(*LISTED_ADDRESSES))
    number = lambda at, size: F.conv(F.substring(F.md5("pattern"), at, size), 16, 10).cast("int")
    both = hosts.union(addresses).filter("pattern <> ''").select("scope", "pattern", F.element_at(F.array(*map(F.lit, CATEGORIES)), number(4, 1) % len(CATEGORIES) + 1).alias("category"), F.date_add(F.to_date(F.lit(FIRST_DAY)), number(5, 2)).alias("since"), number(7, 2).alias("stay"))
    on = both.select("scope", "pattern", "category", F.lit(True).alias("active"), "since")
    off = both.filter("stay % 2 = 1").select("scope", "pattern", "category", F.lit(False).alias("active"), F.date_add("since", F.col("stay")).alias("since"))
    return on.union(off)


def entries_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ENTRIES), "scope string, pattern string, category string, active boolean, since string").withColumn("since", F.to_date("since"))


def captures_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.date_add(F.to_date(F.lit(FIRST_DAY)), F.pmod("page_id", F.lit(DAYS)).cast("int")).alias("fetched"))


def evaluate_sql() -> str:
    """``evaluate`` of the pages, ENTRIES and ``listed``, written as a plain range join."""
    values = ", ".join(f"('{s}', '{p}', '{c}', {a}, DATE '{d}')" for s, p, c, a, d in ENTRIES)
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    number = lambda at, size: f"CAST('0x' || substr(md5(pattern), {at}, {size}) AS INTEGER)"
    return f"""
    WITH fixed(scope, pattern, category, active, since) AS (VALUES {values}),
    pages_at AS (SELECT page_id, regexp_replace(regexp_extract(lower(coalesce(url, '')), '{_HOST}', 1), '\\.$', '') AS host,
                        regexp_replace(regexp_extract(lower(coalesce(url, '')), '{_ADDRESS}', 1), '/+$', '') AS address,
                        DATE '{FIRST_DAY}' + CAST(page_id % {DAYS} AS INTEGER) AS fetched FROM pages),
    named AS (SELECT DISTINCT 'domain' AS scope, host AS pattern FROM pages_at WHERE substr(md5(host), 1, 1) IN ({quoted(LISTED_HOSTS)})
              UNION ALL SELECT DISTINCT 'url', address FROM pages_at WHERE substr(md5(address), 1, 3) IN ({quoted(LISTED_ADDRESSES)})),
    ruled AS (SELECT scope, pattern, (ARRAY[{quoted(CATEGORIES)}])[{number(4, 1)} % {len(CATEGORIES)} + 1] AS category, DATE '{FIRST_DAY}' + {number(5, 2)} AS since, {number(7, 2)} AS stay FROM named WHERE pattern <> ''),
    entries AS (SELECT * FROM fixed UNION ALL SELECT scope, pattern, category, true, since FROM ruled UNION ALL SELECT scope, pattern, category, false, since + stay FROM ruled WHERE stay % 2 = 1),
    spans AS (SELECT *, lead(since) OVER (PARTITION BY scope, pattern, category ORDER BY since, active DESC) AS valid_to FROM entries),
    hit AS (SELECT DISTINCT page_id, category FROM pages_at JOIN spans
            ON active AND since <= fetched AND (valid_to IS NULL OR fetched < valid_to)
            AND (scope = 'domain' AND (host = pattern OR ends_with(host, '.' || pattern)) OR scope = 'url' AND address = pattern))
    SELECT p.page_id, host, CAST(fetched AS VARCHAR) AS fetched, coalesce(c.categories, '') AS categories, c.categories IS NOT NULL AS blocked
    FROM pages_at p LEFT JOIN (SELECT page_id, string_agg(category, ',' ORDER BY category) AS categories FROM hit GROUP BY page_id) c ON p.page_id = c.page_id"""
