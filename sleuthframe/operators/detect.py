"""Detection: declarative rules over normalised events.

Rules are exploded to one row per event code, so matching is an equi-join on the code with
the other criteria as residual predicates, never a nested loop over rules.  A table of few rules
(counted) is broadcast.  Tables of many user rules are indexed: each rule is filed under one
criterion, its longest substring, else an equal value, else its code alone; one automaton over
all substrings runs once over each distinct field value of a batch, so events join only the rules
whose filed criterion they meet, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import columns as C
from ..functions import fixed
from .windows import running_number

#: Rows of a rule table that is broadcast, and words of one automaton.
BROADCAST_RULES, WORDS = 1_000, 200_000
_CRITERIA = (*fixed.CONTAINS_FIELDS, *fixed.EQUALS_FIELDS)


def rules(spark: SparkSession, table=fixed.RULES, tactic: str | None = None) -> DataFrame:
    """(rule_seq, rule_id, level, tactic, technique, rule_code, threshold, want_<field>...) with a row per event code."""
    rows = [(i, *r[:4], code, r[7], *[{**r[5], **r[6]}.get(f) for f in _CRITERIA]) for i, r in enumerate(table) if tactic in (None, r[2]) for code in r[4]]
    wants = ", ".join(f"want_{f} string" for f in _CRITERIA)
    return spark.createDataFrame(rows, f"rule_seq int, rule_id string, level string, tactic string, technique string, rule_code int, threshold int, {wants}")


def normalise(events: DataFrame, data: str = "data") -> DataFrame:
    """Adds the fields that rules look at from a map of event data: the first non-empty alias, else empty."""
    first = lambda names: F.coalesce(*[F.nullif(F.try_element_at(F.col(data), F.lit(n)), F.lit("")) for n in names], F.lit(""))
    return events.withColumns({field: first(names) for field, names in fixed.EVENT_ALIASES.items()})


def _holds(field: str) -> Column:
    want, actual = F.col(f"want_{field}"), F.col(field)
    if field == "logon_type":  # digits compare as numbers: leading zeros don't count
        ok = F.coalesce(actual.try_cast("long") == want.try_cast("long"), F.lit(False))
    elif field in fixed.EQUALS_FIELDS:
        ok = F.coalesce(F.lower(actual) == F.lower(want), F.lit(False))
    else:
        ok = C.contains_ci(actual, want)
    return want.isNull() | ok


def match(events: DataFrame, rule_table: DataFrame, code: str = "event_code", most: int = BROADCAST_RULES) -> DataFrame:
    """Events joined with each rule that they satisfy, before thresholds."""
    criteria = [_holds(f) for f in _CRITERIA if f in events.columns]
    missing = [F.col(f"want_{f}").isNull() for f in _CRITERIA if f not in events.columns]
    if rule_table.limit(most + 1).count() <= most:
        joined = events.join(F.broadcast(rule_table), F.col(code) == F.col("rule_code"))
    else:
        joined = _filed(events, rule_table.filter(C.all_of(missing)) if missing else rule_table, code)
    return joined.filter(C.all_of(criteria + missing)).drop("rule_code", *[f"want_{f}" for f in _CRITERIA])


def _equal_value(field: str, value: Column) -> Column:
    """What two values that count as equal have in common, as text."""
    return value.try_cast("long").cast("string") if field == "logon_type" else F.lower(value)


def _file_of(fields: Sequence[str]) -> Column:
    """The criterion (kind, value) that a rule is filed under."""
    words = F.array_compact(F.array(*[F.when(F.length(f"want_{f}") > 0, F.struct(F.length(f"want_{f}").alias("size"), F.lit(f).alias("kind"), F.lower(F.col(f"want_{f}")).alias("value"))) for f in fields if f in fixed.CONTAINS_FIELDS] or [F.lit(None).cast("struct<size:int,kind:string,value:string>")]))
    longest = F.array_max(words)
    equal = [F.when(F.col(f"want_{f}").isNotNull(), F.struct(F.lit(f).alias("kind"), _equal_value(f, F.col(f"want_{f}")).alias("value"))) for f in fields if f in fixed.EQUALS_FIELDS]
    return F.coalesce(F.when(longest.isNotNull(), F.struct(longest["kind"].alias("kind"), longest["value"].alias("value"))), *equal, F.struct(F.lit("").alias("kind"), F.lit("").alias("value")))


def _words_met(events: DataFrame, words: Mapping[str, list[str]]) -> DataFrame:
    """``events`` plus ``__met``: (field, word) of the words that stand in the fields, letters in small."""
    names, low = events.columns, {f: f"__low_{f}" for f in words}
    rows = events.withColumns({low[f]: F.lower(F.col(f)) for f in words})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automata = {}
        for f, own in words.items():
            automata[f] = ahocorasick.Automaton()
            for w in own:
                automata[f].add_word(w, w)
            automata[f].make_automaton()
        for batch in batches:
            met: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for f, automaton in automata.items():
                coded = batch.column(low[f]).dictionary_encode()
                found = [[{"kind": f, "value": w} for w in {w for _, w in automaton.iter(text)}] for text in coded.dictionary.to_pylist()]
                for i, k in enumerate(coded.indices.to_pylist()):
                    if k is not None and found[k]:
                        met[i] += found[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(met, _MET)], names=[*names, "__met"])

    schema = StructType([*events.schema.fields, StructField("__met", ArrayType(StructType([StructField("kind", StringType()), StructField("value", StringType())])))])
    return rows.mapInArrow(run, schema)


_MET = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))


def _filed(events: DataFrame, rule_table: DataFrame, code: str) -> DataFrame:
    """Events joined with the rules of their code whose filed criterion they meet."""
    fields = [f for f in _CRITERIA if f in events.columns]
    filed = rule_table.withColumn("__f", _file_of(fields)).withColumns({"__kind": F.col("__f.kind"), "__value": F.col("__f.value")}).drop("__f")
    # A word a rule at most goes to the driver, which gives each task the automaton's words: blocks of a bounded number.
    listed = [(r[0], r[1]) for r in filed.filter(F.col("__kind").isin(*fixed.CONTAINS_FIELDS)).select("__kind", "__value").distinct().collect()]
    equal = [F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("kind"), _equal_value(f, F.col(f)).alias("value"))) for f in fields if f in fixed.EQUALS_FIELDS]
    own = F.array_compact(F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("value")), *equal))
    met = events.withColumn("__met", own)
    for at in range(0, len(listed), WORDS):
        words: dict[str, list[str]] = {}
        for f, w in listed[at : at + WORDS]:
            words.setdefault(f, []).append(w)
        met = met.unionByName(_words_met(events, words))
    keyed = met.withColumn("__m", F.explode("__met")).drop("__met")
    same = (F.col(code) == F.col("rule_code")) & (F.col("__m.kind") == F.col("__kind")) & (F.col("__m.value") == F.col("__value"))
    return keyed.join(filed, same).drop("__m", "__kind", "__value")


def alerts(events: DataFrame, rule_table: DataFrame, order: str = "seq", code: str = "event_code", scope: tuple[str, ...] = ()) -> DataFrame:
    """Alerts: matches of rules, of a rule with a threshold only the N-th match and every later one.

    The count is global, in the order of ``order``, which must be unique; ``scope`` counts for
    each host or user instead.  Rules without a threshold need no window, so only the matches
    of threshold rules are shuffled, and those of one rule are numbered in blocks of the order.
    """
    matched = match(events, rule_table, code)
    plain = matched.filter("threshold <= 1")
    counted = running_number(matched.filter("threshold > 1"), ["rule_id", *scope], order, "__n").filter("__n >= threshold").drop("__n")
    return plain.unionByName(counted)


def alert_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_id", "level", "tactic", "technique").agg(F.count("*").alias("alerts"))
