"""The case store: investigations, artifacts, indicators, timeline as plain Parquet tables.

No ACID table format comes with Spark.  A table is a set of folders, dealt by the hash slot of
the case (or of the row's own key), and a manifest for each version that lists the folders of
each slot.  A change writes new folders and then the next manifest: appended rows are a further
folder of their slots, changed or deleted ones a new folder of just the slots that hold
them.  Readers keep the manifest that they started with.  Slots of many folders are put together
by ``compact``, versions that nobody needs any more go with ``expire``.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from .indicators import insert_or_ignore

SCHEMAS: dict[str, str] = {
    "investigations": "id string, name string, description string, status string, created_by long, created_at timestamp_ntz, updated_at timestamp_ntz",
    "artifacts": "id long, investigation_id string, filename string, original_filename string, file_path string, file_size long, file_hash_md5 string, file_hash_sha1 string, file_hash_sha256 string, file_type string, analysis_result string, uploaded_by long, uploaded_at timestamp_ntz",
    "iocs": "id long, investigation_id string, type string, value string, source string, severity string, enrichment string, tags string, created_at timestamp_ntz",
    "timeline_events": "id string, investigation_id string, timestamp string, event string, severity string, source string, artifact_id long, created_at timestamp_ntz",
    "audit_log": "id long, user_id long, username string, action string, target_type string, target_id string, details string, ip_address string, created_at timestamp_ntz",
    "integration_configs": "id long, connector_id string, enabled boolean, config map<string,string>, last_test_status string, last_test_message string, last_test_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
    "users": "id long, username string, display_name string, role string, created_at timestamp_ntz, last_login timestamp_ntz",
}
CHILDREN = ("artifacts", "iocs", "timeline_events")
UNIQUE = {"iocs": ("investigation_id", "type", "value"), "integration_configs": ("connector_id",), "users": ("username",)}
#: Column whose hash gives a row's slot.
SLOT_KEYS = {"investigations": "id", "integration_configs": "connector_id", "users": "username", "audit_log": "id"} | dict.fromkeys(CHILDREN, "investigation_id")
SLOTS = 64
#: Folders of a slot from which ``compact`` puts it together.
MANY = 8
DEFAULT_PAGE, MAX_PAGE = 50, 200


class CaseStore:
    """Versioned tables under one root folder; a single writer per table, any number of readers."""

    def __init__(self, spark: SparkSession, root: str, slots: int = SLOTS):
        self.spark, self.root, self.slots = spark, root.rstrip("/"), slots
        self._jvm = spark.sparkContext._jvm

    # --- files ---

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    @property
    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return [f.getPath().getName() for f in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def versions(self, table: str) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(table, "manifests") if n.endswith(".json"))

    def manifest(self, table: str, version: int | None = None) -> dict[int, list[str]]:
        """Folders of each slot in a version (the last one), oldest first."""
        there = self.versions(table)
        if not there:
            return {}
        stream = self._fs.open(self._path(table, "manifests", f"{there[-1] if version is None else version:012d}.json"))
        try:
            body = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(body)
        self.slots = found["slots"]
        return {int(k): v for k, v in found["folders"].items()}

    def _publish(self, table: str, folders: Mapping[int, list[str]]) -> None:
        """The next manifest; it is there whole, or not at all if another writer was first."""
        version = max(self.versions(table), default=0) + 1
        draft, final = self._path(table, "manifests", f".{uuid.uuid4().hex}"), self._path(table, "manifests", f"{version:012d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps({"slots": self.slots, "folders": folders}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"another writer has changed {table}")

    def _store(self, table: str, rows: DataFrame) -> dict[int, str]:
        """Writes rows as a folder for each slot that they fall into."""
        name = uuid.uuid4().hex
        shaped = _fill(rows, SCHEMAS[table], self.spark).withColumn("slot", self._slot(table))
        # One file a slot, more where a slot is large: the rebalance splits skewed ones.
        shaped.hint("rebalance", "slot").write.partitionBy("slot").parquet(f"{self.root}/{table}/data/{name}")
        return {int(n[5:]): f"{name}/{n}" for n in self._names(table, "data", name) if n.startswith("slot=")}

    def _slot(self, table: str) -> Column:
        return F.pmod(F.hash(SLOT_KEYS[table]), F.lit(self.slots))

    # --- reading ---

    def _load(self, table: str, folders: Mapping[int, list[str]]) -> DataFrame:
        paths = [f"{self.root}/{table}/data/{f}" for fs in folders.values() for f in fs]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*paths)

    def read(self, table: str, version: int | None = None, keys: Sequence | None = None) -> DataFrame:
        """A table, at a version; with ``keys`` (of the slot's column) only their rows, from their slots."""
        folders = self.manifest(table, version)
        if keys is None:
            return self._load(table, folders)
        wanted = self._slots_of(table, self._keys(table, keys))
        return self._load(table, {s: f for s, f in folders.items() if s in wanted}).filter(F.col(SLOT_KEYS[table]).isin(list(keys)))

    def _keys(self, table: str, keys: Sequence) -> DataFrame:
        kind = self.spark.createDataFrame([], SCHEMAS[table]).schema[SLOT_KEYS[table]].dataType.simpleString()
        return self.spark.createDataFrame([(k,) for k in keys], f"{SLOT_KEYS[table]} {kind}")

    def _slots_of(self, table: str, rows: DataFrame) -> set[int]:
        """Slots of rows with the slot's column: numbers below ``slots``."""
        return {r[0] for r in rows.select(self._slot(table)).distinct().collect()}

    # --- changes ---

    def write(self, table: str, rows: DataFrame) -> None:
        """A version of just these rows."""
        self._publish(table, {s: [f] for s, f in self._store(table, rows).items()})

    def append(self, table: str, rows: DataFrame) -> None:
        """Rows as further folders of their slots; nothing that is there is read or written again."""
        folders = self.manifest(table)
        added = self._store(table, rows)
        self._publish(table, folders | {s: [*folders.get(s, []), f] for s, f in added.items()})

    def _rewrite(self, table: str, slots: set[int], change: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces the rows of some slots by what ``change`` makes of them; others keep their folders."""
        folders = self.manifest(table)
        new = self._store(table, change(self._load(table, {s: f for s, f in folders.items() if s in slots})))
        self._publish(table, {s: f for s, f in folders.items() if s not in slots} | {s: [f] for s, f in new.items()})

    def insert_or_ignore(self, table: str, rows: DataFrame, order: str) -> int:
        """Adds rows whose unique key is new (the first by ``order`` of each); returns how many.  Reads only the slots that they fall into."""
        folders = self.manifest(table)
        wanted = self._slots_of(table, rows)
        old = self._load(table, {s: f for s, f in folders.items() if s in wanted})
        added = self._store(table, insert_or_ignore(rows, old, UNIQUE[table], order))
        if not added:
            return 0
        self._publish(table, folders | {s: [*folders.get(s, []), f] for s, f in added.items()})
        return self._load(table, {s: [f] for s, f in added.items()}).count()

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Replaces non-null columns of rows with an equal key and adds the others; only slots with changed rows are written."""
        key = UNIQUE.get(table, ("id",))
        rows = _fill(rows, SCHEMAS[table], self.spark)
        if SLOT_KEYS[table] in key:
            slots = self._slots_of(table, rows)
        else:
            # The key doesn't tell the slot: it is that of the rows that are there, or of new ones.
            at = self.read(table).join(rows.select(*key), list(key), "left_semi")
            slots = self._slots_of(table, at.select(SLOT_KEYS[table]).union(rows.select(SLOT_KEYS[table])))
        self._rewrite(table, slots, lambda old: upsert(old, rows, key))

    def delete(self, investigation_ids: Sequence[str]) -> None:
        """Deletes investigations with their artifacts, indicators and timeline; only their slots are written."""
        for table in ("investigations", *CHILDREN):
            gone = self._keys(table, investigation_ids)
            if self.versions(table):
                self._rewrite(table, self._slots_of(table, gone), lambda old, gone=gone.toDF("gone"), table=table: without(old, gone, SLOT_KEYS[table]))

    # --- upkeep ---

    def compact(self, table: str, many: int = MANY) -> int:
        """Puts slots of ``many`` folders or more together; returns their number."""
        slots = {s for s, f in self.manifest(table).items() if len(f) >= many}
        if slots:
            self._rewrite(table, slots, lambda old: old)
        return len(slots)

    def expire(self, table: str, keep: int = 2) -> int:
        """Forgets all but the last ``keep`` versions and deletes the folders that these don't list; returns the number of folders.

        Readers of an older version, and a write that isn't published yet, must have ended.
        """
        there = self.versions(table)
        for v in there[:-keep]:
            self._fs.delete(self._path(table, "manifests", f"{v:012d}.json"), False)
        used = {f for v in there[-keep:] for fs in self.manifest(table, v).values() for f in fs}
        gone = [f"{w}/{n}" for w in self._names(table, "data") for n in self._names(table, "data", w) if n.startswith("slot=") and f"{w}/{n}" not in used]
        for f in gone:
            self._fs.delete(self._path(table, "data", f), True)
        for w in self._names(table, "data"):
            if not any(n.startswith("slot=") for n in self._names(table, "data", w)):
                self._fs.delete(self._path(table, "data", w), True)
        return len(gone)


def _fill(rows: DataFrame, schema: str, spark: SparkSession) -> DataFrame:
    fields = spark.createDataFrame([], schema).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone, F.col(key) == F.col(gone.columns[0]), "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """``old`` overlaid with the non-null values of ``new`` by key."""
    fresh = new.select(*[F.col(c).alias(f"__{c}") for c in new.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    return old.join(fresh, same, "full").select(*[F.coalesce(f"__{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns])


# --- queries -----------------------------------------------------------------------------


def search(rows: DataFrame, text: str | None = None, columns: Sequence[str] = ("name", "description"), equal: Mapping[str, tuple[str | None, Sequence[str]]] | None = None) -> DataFrame:
    """Substring search over columns (case-insensitive; % and _ of the text are wildcards) and equality filters.

    ``equal`` maps a column to (wanted, allowed): a wanted value that isn't allowed is ignored.
    """
    tests: list[Column] = []
    if text:
        tests.append(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{text}%") for c in columns]))
    for column, (wanted, allowed) in (equal or {}).items():
        if wanted in allowed:
            tests.append(F.col(column) == wanted)
    return rows.filter(C.all_of(tests)) if tests else rows


def page(rows: DataFrame, number: int = 1, size: int = DEFAULT_PAGE, order: Sequence[Column | str] = ()) -> DataFrame:
    """One page; the number is at least 1, the size between 1 and 200.  ``order`` must end in a unique column."""
    number, size = max(1, number), min(max(1, size), MAX_PAGE)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


class PageIndex:
    """Rows in a total order, dealt by range and written once, so that any page is read from one or two ranges.

    ``path/rows`` holds the rows with the number of their range and their place in it, sorted, so
    that Parquet's bounds leave out all but the row groups of a page; ``path/ranges`` holds the size of
    each range, which summed up tells where a page starts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        ranges = spark.read.parquet(f"{self.path}/ranges").orderBy("__range").collect()
        self.ranges = [r["__range"] for r in ranges]
        self.ends = list(accumulate(r["n"] for r in ranges))

    @classmethod
    def build(cls, rows: DataFrame, path: str, order: Sequence[Column | str], row_group: int = 4 << 20) -> PageIndex:
        """Writes the index; ``order`` must end in a unique column."""
        placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        path = path.rstrip("/")
        placed.withColumn("__range", F.spark_partition_id()).withColumn("__place", place).write.option("parquet.block.size", row_group).parquet(f"{path}/rows")
        written = rows.sparkSession.read.parquet(f"{path}/rows")
        written.groupBy("__range").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/ranges")
        return cls(rows.sparkSession, path)

    def page(self, number: int = 1, size: int = DEFAULT_PAGE) -> DataFrame:
        """One page, as ``page`` gives it."""
        number, size = max(1, number), min(max(1, size), MAX_PAGE)
        begin, tests = (number - 1) * size, []
        i = bisect_right(self.ends, begin)
        while i < len(self.ends) and (first := self.ends[i - 1] if i else 0) < begin + size:
            tests.append((F.col("__range") == self.ranges[i]) & F.col("__place").between(max(begin - first, 0), begin + size - first - 1))
            i += 1
        rows = self.spark.read.parquet(f"{self.path}/rows")
        found = rows.filter(reduce(lambda a, b: a | b, tests)) if tests else rows.limit(0)
        return found.orderBy("__range", "__place").drop("__range", "__place")


def page_after(rows: DataFrame, last: Mapping[str, object] | None, order: Mapping[str, bool], size: int = DEFAULT_PAGE) -> DataFrame:
    """The page after the row with the values ``last`` (none: the first page): no row before it is sorted.

    ``order`` maps columns without nulls to whether they ascend; together they are unique.  The
    bound on the leading column reaches the scan.
    """
    if last is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for name, up in order.items():
            value = F.lit(last[name])
            beyond, equal = beyond | (equal & (F.col(name) > value if up else F.col(name) < value)), equal & (F.col(name) == value)
        lead, up = next(iter(order.items()))
        rows = rows.filter(F.col(lead) >= F.lit(last[lead]) if up else F.col(lead) <= F.lit(last[lead])).filter(beyond)
    by = [F.col(c).asc() if up else F.col(c).desc() for c, up in order.items()]
    return rows.orderBy(*by).limit(min(max(1, size), MAX_PAGE))


def with_child_counts(parents: DataFrame, children: Mapping[str, tuple[DataFrame, str]], key: str = "id") -> DataFrame:
    """Parents with a count of each kind of child; children are counted before the join."""
    out = parents
    for name, (child, ref) in children.items():
        counts = child.groupBy(F.col(ref).alias("__ref")).agg(F.count("*").alias("__n"))
        out = out.join(counts, F.col(key) == F.col("__ref"), "left").withColumn(name, F.coalesce("__n", F.lit(0))).drop("__ref", "__n")
    return out


def detail(parents: DataFrame, children: Mapping[str, tuple[DataFrame, str, Sequence[str]]], key: str = "id") -> DataFrame:
    """Parents with each kind of child nested as an array, sorted by its leading columns."""
    out = parents
    for name, (child, ref, order) in children.items():
        rest = [c for c in child.columns if c not in order]
        nested = child.groupBy(F.col(ref).alias("__ref")).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
        out = out.join(nested, F.col(key) == F.col("__ref"), "left").drop("__ref")
    return out


def orphans(files: DataFrame, artifacts: DataFrame, older_than: Column) -> DataFrame:
    """Files that no artifact names, by file name or by base name of its path, and that are old enough."""
    kept = artifacts.select(F.col("filename").alias("__name")).union(artifacts.select(C.base_name(F.col("file_path")))).filter("__name is not null").distinct()
    return files.join(kept, files["name"] == F.col("__name"), "left_anti").filter(F.col("modified_at") < older_than)


def migrate_sessions(sessions: DataFrame) -> DataFrame:
    """(investigation_id, type, value, source) from old session documents (id, iocs map<string, array<string>>)."""
    kinds = F.explode(F.map_entries("iocs"))
    rows = sessions.select(F.col("id").alias("investigation_id"), kinds.alias("e")).select("investigation_id", F.col("e.key").alias("old"), F.explode("e.value").alias("entry"))
    # An entry is the value itself or an object that holds it.
    value = F.coalesce(F.get_json_object("entry", "$.valeur"), F.get_json_object("entry", "$.value"), F.col("entry"))
    return rows.select("investigation_id", C.lookup(F.col("old"), fixed.SESSION_KEYS).alias("type"), value.alias("value"), F.lit("migration").alias("source")).filter("type is not null and value <> ''")


# --- case memory ----------------------------------------------------------------------------


def clean_findings(rows: DataFrame, order: str) -> DataFrame:
    """Findings with sequential ids in their case, enumerations checked, long texts cut."""
    from .windows import numbered

    return (
        numbered(rows, ["case_id"], order)
        .withColumn("severity", C.one_of(F.col("severity"), fixed.SEVERITIES, "info"))
        .withColumn("confidence", C.one_of(F.col("confidence"), fixed.CONFIDENCES, "possible"))
        .withColumn("title", F.left("title", F.lit(300)))
        .withColumn("evidence", F.left("evidence", F.lit(1000)))
    )


def findings_summary(findings: DataFrame, hypotheses: DataFrame, plan: DataFrame) -> DataFrame:
    """(case_id, findings, critical_or_high, verified, unverified, hypotheses_confirmed, hypotheses_open, plan_remaining)."""
    f = findings.groupBy("case_id").agg(F.count("*").alias("findings"), F.count_if(F.col("severity").isin("critical", "high")).alias("critical_or_high"), F.count_if(F.col("verification") == "verified").alias("verified"), F.count_if(F.col("verification").isin("unverified", "refuted")).alias("unverified"))
    h = hypotheses.groupBy("case_id").agg(F.count_if(F.col("status") == "confirmed").alias("hypotheses_confirmed"), F.count_if(F.col("status") == "open").alias("hypotheses_open"))
    p = plan.groupBy("case_id").agg(F.count_if(F.coalesce(F.col("status"), F.lit("")) != "done").alias("plan_remaining"))
    joined = f.join(h, "case_id", "full").join(p, "case_id", "full")
    return joined.na.fill(0)
