"""Scalar functions of the forensic model as Column expressions: all inside whole-stage code generation, no Python."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_EPOCH_1601_MICROS = 11_644_473_600_000_000


def lookup(key: Column, table: Mapping, default: Column | None = None) -> Column:
    """Value of a small fixed table, else ``default`` (null)."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def find_all(text: Column, pattern: str) -> Column:
    """All matches with Unicode classes, as Python's ``re`` finds them."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def ioc_candidates(text: Column) -> Column:
    """The distinct parts of a text that may hold an indicator, joined by spaces.

    No indicator holds white space, angle brackets or quotes, and these are word boundaries, so all
    matches of a text are those of its parts.  One scan cuts it; the eight patterns then see
    only parts with a full stop, a scheme, 32 hex digits or the letters of a CVE.
    """
    parts = F.array_distinct(F.split(text, "(?U)[\\s<>\"']+"))
    likely = F.filter(parts, lambda p: p.contains(".") | p.contains("://") | (F.length(p) >= 12) & p.rlike("[a-fA-F0-9]{32}|[Cc][Vv][Ee]-"))
    return F.array_join(likely, " ")


def extract_iocs(text: Column, types: Iterable[str] | None = None) -> Column:
    """array<struct(type, value)> of indicators in a text, each type's distinct matches before case folding.

    One expression over one scan of the text.  A cheap guard skips the full pattern of a
    family on texts that can't hold it.  Private addresses and denied domains are left out.
    """
    wanted = set(types or [t for t, _, _ in fixed.IOC_PATTERNS])
    families = []
    for kind, pattern, guard in fixed.IOC_PATTERNS:
        if kind not in wanted:
            continue
        found = F.array_distinct(find_all(text, pattern))
        if kind == "ip":
            found = F.filter(found, lambda v: ~v.rlike(fixed.PRIVATE_IP))
        if kind == "domain":
            found = F.filter(found, lambda v: ~F.lower(v).isin(*fixed.DENIED_DOMAINS))
        rows = F.transform(found, _typed(kind))
        none = F.array().cast("array<struct<type:string,value:string>>")
        families.append(F.when(text.rlike(guard), rows).otherwise(none))
    return F.concat(*families)


def _typed(kind: str):
    """A value as struct(type, value) in the type's case: addresses and URLs as they are, CVE in capitals, the rest in small letters."""
    if kind in ("ip", "url"):
        return lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    fold = F.upper if kind == "cve" else F.lower
    return lambda v: F.struct(F.lit(kind).alias("type"), fold(v).alias("value"))


def log_severity(line: Column) -> Column:
    """First severity, from critical down to low, one of whose words stands anywhere in the line; else info."""
    low = F.lower(line)
    out = F.lit("info")
    for severity, words in reversed(fixed.SEVERITY_WORDS.items()):
        out = F.when(low.rlike("|".join(words)), F.lit(severity)).otherwise(out)
    return out


def log_timestamp(line: Column) -> Column:
    """Text of the first timestamp pattern, in order of priority, that matches; else empty."""
    found = [F.nullif(F.regexp_extract(line, "(?U)" + p, 1), F.lit("")) for p in fixed.TIMESTAMPS]
    return F.coalesce(*found, F.lit(""))


def syslog(line: Column) -> Column:
    """struct(ts, host, process, pid, message) of a syslog line; null if it is none, pid null if absent."""
    part = lambda i: F.regexp_extract(line, "(?U)" + fixed.SYSLOG, i)
    fields = [part(i).alias(n) for i, n in ((1, "ts"), (2, "host"), (3, "process"))] + [F.nullif(part(4), F.lit("")).alias("pid"), part(5).alias("message")]
    return F.when(line.rlike("(?U)" + fixed.SYSLOG), F.struct(*fields))


def level_severity(level: Column) -> Column:
    return lookup(level.cast("int"), fixed.LEVEL_SEVERITY, F.lit("info"))


def csv_severity(value: Column) -> Column:
    return lookup(F.lower(value), fixed.CSV_SEVERITY, F.lit("info"))


def contains_ci(actual: Column, wanted: Column) -> Column:
    """Case-insensitive substring; null never matches."""
    return F.coalesce(F.contains(F.lower(actual), F.lower(wanted)), F.lit(False))


def stix_pattern(kind: Column, value: Column) -> Column:
    """STIX 2.1 pattern of an indicator; null for types without one.  Only single quotes are escaped."""
    safe = F.replace(value, F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("["), lookup(kind, fixed.STIX_PATHS), F.lit(" = '"), safe, F.lit("']"))


def confidence(severity: Column) -> Column:
    return lookup(F.coalesce(severity, F.lit("unknown")), fixed.CONFIDENCE_OF, F.lit(50))


def uuid5_url(name: Column) -> Column:
    """Version-5 UUID in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(fixed.NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def url_id(url: Column) -> Column:
    """URL-safe base64 without padding."""
    # Spark may part base64 into lines of 76 characters.
    return F.translate(F.base64(F.encode(url, "UTF-8")), "+/=\r\n", "-_")


def webkit_time(micros: Column) -> Column:
    """UTC timestamp of microseconds since 1601; null for 0."""
    return F.when(micros != 0, F.timestamp_micros(micros - F.lit(_EPOCH_1601_MICROS)))


def unix_micros_time(micros: Column) -> Column:
    return F.when(micros != 0, F.timestamp_micros(micros))


def filetime(ticks: Column) -> Column:
    """UTC timestamp of 100 ns ticks since 1601; null for 0."""
    return F.when(ticks != 0, F.timestamp_micros(F.call_function("div", ticks, F.lit(10)) - F.lit(_EPOCH_1601_MICROS)))


def little_endian(content: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian integer of up to 7 bytes at a byte offset."""
    digits = F.hex(F.substring(content, offset + 1, size))
    return F.conv(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]), 16, 10).cast("long")


def mask_secret(value: Column) -> Column:
    """*** and the last four characters; only *** for values of four characters or fewer."""
    return F.when(F.length(value) > 4, F.concat(F.lit("***"), F.right(value, F.lit(4)))).otherwise(F.lit("***"))


def merge_config(old: Column, new: Column) -> Column:
    """Old settings overlaid with the new ones that are neither empty nor masked."""
    kept = F.map_filter(new, lambda k, v: v.isNotNull() & (v != "") & ~v.startswith("***"))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(kept), k)), kept)


def sanitize(text: Column, most: int = 10_000) -> Column:
    """Without NUL characters, trimmed, cut."""
    return F.left(F.trim(F.replace(text, F.lit("\x00"), F.lit(""))), F.lit(most))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def safe_report_id(value: Column) -> Column:
    """Base name of a report id; null if it is empty or would climb out of its folder."""
    clean = base_name(value)
    return F.when((clean != "") & ~clean.contains("..") & ~clean.contains("\\"), clean)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?<=[^.])(\.[^.]+)$", 1))


def file_type(name: Column) -> Column:
    ext = extension(name)
    return lookup(ext, fixed.FILE_TYPES, F.concat(F.lit("Inconnu ("), F.when(ext == "", F.lit("sans extension")).otherwise(ext), F.lit(")")))


def client_ip(forwarded: Column, remote: Column) -> Column:
    """First address of X-Forwarded-For, else the remote address."""
    return F.coalesce(F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit("")), remote)


def key_values(cells: Column, most: int = 5) -> Column:
    """``k=v`` of the first cells of a map, comma-joined."""
    return F.array_join(F.transform(F.slice(F.map_entries(cells), 1, most), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ", ")


def one_of(value: Column, allowed: Iterable[str], default: str) -> Column:
    """The value if it is allowed, else the default."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), severity)


def ioc_outcome(kind: Column, value: Column) -> Column:
    """Import verdict of a row: missing, bad_type or valid."""
    empty = kind.isNull() | (kind == "") | value.isNull() | (F.trim(value) == "")
    return F.when(empty, F.lit("missing")).when(~kind.isin(*fixed.IOC_TYPES), F.lit("bad_type")).otherwise(F.lit("valid"))


def is_uuid(value: Column) -> Column:
    return F.coalesce(value.rlike(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"), F.lit(False))


def any_substring(text: Column, needles: Iterable[str]) -> Column:
    """Whether one of the lower-case needles stands in the text, case aside."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(n)) for n in needles])


def all_of(conditions: Iterable[Column]) -> Column:
    """Conjunction; true for none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def greynoise_message(classification: Column, noise: Column) -> Column:
    """Readable scanner verdict: its classification, and whether the address scans everyone or targets."""
    return F.concat(F.lit("GreyNoise: "), F.coalesce(classification, F.lit("unknown")), F.when(F.coalesce(noise, F.lit(False)), F.lit(" (noise)")).otherwise(F.lit(" (targeted)")))


def threatfox_severity(score: Column) -> Column:
    return F.when(score >= 75, F.lit("high")).otherwise(F.lit("medium"))
