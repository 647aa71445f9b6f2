"""Exact substring dedup with distributed suffix sorting.

Bytes covered by a string of ``LENGTH`` bytes that starts anywhere else in the corpus are
removed.  One suffix array of a corpus fits no machine, so suffixes are dealt into buckets
by content: a window of LENGTH bytes belongs to its *anchor*, the ANCHOR-byte string in it
with the least hash (leftmost of equals).  Equal windows have equal anchors at equal places,
so no match is lost between buckets, and a window whose anchor stands nowhere else is unique.

Neighbouring windows of one anchor form a *block* of at most LENGTH - ANCHOR windows.  Equal
blocks are counted together before any shuffle of bytes, so a third of all rows being copies
is one row a task, and a block that occurs more than once stands twice in its bucket.  Buckets
are suffix-sorted by linear grouping construction (``suffixsort``): bytes between the places
where blocks part become one symbol, and a window is repeated if its suffix shares LENGTH
bytes with a neighbour in the suffix array; nothing is removed by any other way but whole
texts that stand twice.  The places where blocks part come from an ordinary sort of a bucket's
blocks (k log k comparisons of bytes for k blocks), which the linear part then builds on.
Anchors with more than ``BUCKET`` different blocks are split exactly, by halving the range of
window starts and keying on the bytes that all windows of a half share, until buckets are
small or a half is a single window, where equal keys are equal windows.

Shuffled are 50 bytes for each anchor (about one in 170 bytes of text), and the texts that
share an anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .durable import Scratch
from .jaccard import _bloom_hits, _text_key
from .suffixsort import common_prefixes, suffix_array

LENGTH = 400
ANCHOR = 64
#: Different blocks of a bucket that are sorted together; larger buckets are split without loss.
BUCKET = 128


def blocks(data: np.ndarray, off: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """Blocks of a chunk of texts: text number, start in the text, lead (anchor's place in the block), windows, hashes of anchor and block."""
    n, reach = len(data), length - anchor + 1
    names = ("text", "start", "lead", "windows", "anchor", "block")
    if n < length:
        return {k: np.zeros(0, np.int64) for k in names}
    prefix = B.prefix_hash(data)
    m, nw = n - anchor + 1, n - length + 1
    hashed = B.mix((prefix[anchor:] - prefix[:m]) * B.powers(m)[1])
    # The least hash, leftmost of equals, of every ``reach`` neighbours: minima from both ends of rows of that length.
    rows = -(-m // reach)
    value = np.full(rows * reach, np.uint64(2**64 - 1))
    value[:m] = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    table = value.reshape(rows, reach)
    left = np.minimum.accumulate(table, axis=1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(right[:nw], left[reach - 1 : reach - 1 + nw]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(nw + 1, bool)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= length:
            inside[a : b - length + 1] = True
    inside[nw] = False
    first = inside[:nw].copy()
    first[1:] &= ~inside[: nw - 1] | (at[1:] != at[:-1])
    # Texts that follow each other without a gap of starts can't occur: the last length - 1 starts of a text are outside.
    start = np.flatnonzero(first)
    stop = ~inside[1:] & inside[:-1]
    stop[:-1] |= inside[: nw - 1] & first[1:]
    end = np.flatnonzero(stop)
    text = np.searchsorted(off, start, "right") - 1
    return {"text": text, "start": start - off[text], "lead": at[start] - start, "windows": end - start + 1, "anchor": hashed[at[start]].view(np.int64), "block": B.span_hash(prefix, start, end + length).view(np.int64)}


def _partings(contents: Sequence[bytes], leads: Sequence[int]) -> tuple[set[int], set[int]]:
    """Where blocks part before the anchor and after it, counted from it: common prefixes of neighbours in order of the bytes each way."""
    k = len(contents)
    after = sorted(range(k), key=lambda x: contents[x][leads[x] :])
    ahead = {x: contents[x][: leads[x]][::-1] for x in range(k)}
    before = sorted(range(k), key=ahead.__getitem__)
    right = {_shared(contents[x][leads[x] :], contents[y][leads[y] :]) for x, y in zip(after, after[1:], strict=False)}
    left = {-_shared(ahead[x], ahead[y]) for x, y in zip(before, before[1:], strict=False)}
    return left, right


def repeated_windows(contents: Sequence[bytes | None], leads: Sequence[int], windows: Sequence[int], twice: Sequence[bool], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each of different blocks of a bucket, ranges [from, to) of window starts whose window stands elsewhere too.

    Blocks are aligned at their leads, and window starts are counted from there.  A block
    that occurs more than once is ``twice`` in the sorted text.  A block alone in its bucket
    needs no content: it is one symbol.
    """
    k = len(contents)
    sizes = [w + length - 1 for w in windows]
    left, right = _partings(contents, leads) if k > 1 else (set(), set())
    right |= {n - e for n, e in zip(sizes, leads, strict=True)}
    left |= {-e for e in leads}
    # Window starts between two cuts have the same fate: starts part at left cuts, ends (exclusive) after right ones.
    cuts = sorted(left | right | {0} | {r - length + 1 for r in right})
    text: list[int] = []
    homes: list[tuple[int, int]] = []
    symbols: dict[tuple[int, bytes | None], int] = {}
    spans: list[list[int]] = []
    for x in range(k):
        lo, hi = -leads[x], sizes[x] - leads[x]
        own = [c for c in cuts if lo <= c <= hi]
        spans.append(own)
        word = [symbols.setdefault((a, contents[x][a - lo : b - lo] if k > 1 else None), len(symbols)) + 2 for a, b in zip(own, own[1:], strict=False)]
        for _ in range(2 if twice[x] else 1):
            text += [*word, 1]
            homes += [*((x, i) for i in range(len(word))), (x, -1)]
    text.append(0)
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    out: list[set[tuple[int, int]]] = [set() for _ in range(k)]
    for rank in range(1, len(order)):
        x, i = homes[order[rank]]
        if i < 0:
            continue
        own = spans[x]
        if own[i] + length > own[-1]:
            continue
        most = max(shared[rank], shared[rank + 1] if rank + 1 < len(order) else 0)
        # Starts own[i] .. own[i + 1] - 1: the end of the last one must be shared.
        if own[min(i + most, len(own) - 1)] >= own[i + 1] - 1 + length:
            out[x].add((own[i], own[i + 1]))
    return [sorted(r) for r in out]


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y))


_OCCURRENCE = "anchor long, block long, text_key binary, start long, lead int, windows int"


def _occurrences(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """Blocks of every text, once per text and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys = batch.column("text_key").to_pylist()
            for lo, hi, data, off in B.chunks(batch.column("text")):
                found = blocks(data, off, length, anchor)
                new = np.zeros(hi - lo, bool)
                for i in range(hi - lo):
                    if off[i + 1] - off[i] >= length and (key := keys[lo + i]) not in seen:
                        seen.add(key)
                        new[i] = True
                if len(seen) > 500_000:
                    seen.clear()
                ok = new[found["text"]]
                if ok.any():
                    take = {k: v[ok] for k, v in found.items()}
                    texts = pa.array(keys[lo:hi], pa.binary()).take(pa.array(take["text"]))
                    yield pa.RecordBatch.from_arrays([pa.array(take["anchor"]), pa.array(take["block"]), texts, pa.array(take["start"]), pa.array(take["lead"].astype(np.int32)), pa.array(take["windows"].astype(np.int32))], names=["anchor", "block", "text_key", "start", "lead", "windows"])

    return docs.select(_text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") >= length).mapInArrow(run, _OCCURRENCE)


#: A bucket holds the blocks of one anchor, cut to window starts [lo, hi), that share the bytes of all those windows.
_BUCKET_KEY = ["anchor", "lo", "hi", "core"]


def _sorted_buckets(length: int):
    """Rows of buckets, those of a bucket together, to rows (key, block, from, to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        rows: list[tuple[int, bytes | None, int, int, bool]] = []
        out: list[tuple] = []

        def solve() -> None:
            block, *columns = zip(*rows, strict=True)
            for b, ranges in zip(block, repeated_windows(*columns, length), strict=True):
                out.extend((*held, b, lo, hi) for lo, hi in ranges)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 7
            out.clear()
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*_BUCKET_KEY, "block", "from", "to"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*_BUCKET_KEY, "block", "data", "lead", "windows", "twice")]
            for *key, block, data, lead, windows, twice in zip(*columns, strict=True):
                if held != (key := tuple(key)):
                    if held is not None:
                        solve()
                    held, rows = key, []
                rows.append((block, data, lead, windows, twice))
                if len(out) > 10_000:
                    yield flush()
        if held is not None:
            solve()
        yield flush()

    return run


def _slices(length: int, anchor: int):
    """Texts with the blocks that they stand for to rows of buckets: all blocks of a text are cut from its bytes at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 100) for b in batches for i in range(0, b.num_rows, 100)):
            out = []
            for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
                data = text.as_py().encode()
                for w in wanted.as_py():
                    out.append((w["anchor"], anchor - length, 1, 0, w["block"], data[w["start"] : w["start"] + w["windows"] + length - 1], w["lead"], w["block"], w["weight"]))
            columns = list(zip(*out, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _STATE_TYPES, strict=True)], names=_STATE_NAMES)

    return run


def _halves(length: int):
    """Rows of a bucket to rows of its two halves: blocks cut to their windows, keyed by what all windows of the half share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("anchor", "lo", "hi", "data", "lead", "origin", "weight")]
            for anchor, lo, hi, data, lead, origin, weight in zip(*columns, strict=True):
                middle = (lo + hi) // 2
                last = len(data) - lead - length  # its last window start
                for a, b in ((lo, middle), (middle, hi)):
                    s, e = max(a, -lead), min(b - 1, last)
                    if s > e:
                        continue
                    part = data[s + lead : e + length + lead]
                    core = data[b - 1 + lead : a + length + lead]
                    digest = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)
                    out.append((anchor, a, b, digest(core), digest(part + (-s).to_bytes(4, "little", signed=True)), part, -s, origin, weight))
            columns = list(zip(*out, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _STATE_TYPES, strict=True)], names=_STATE_NAMES)

    return run


_STATE = "anchor long, lo int, hi int, core long, block long, data binary, lead int, origin long, weight long"
_STATE_NAMES = [*_BUCKET_KEY, "block", "data", "lead", "origin", "weight"]
_STATE_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64())
_RANGES = "anchor long, lo int, hi int, core long, block long, `from` int, `to` int"


def _repeats(kinds: DataFrame, several: DataFrame, texts: DataFrame, length: int, anchor: int, bucket: int, scratch: Scratch) -> list[DataFrame]:
    """Tables (anchor, origin, from, to): window starts, counted from the anchor, of blocks (origin) that stand elsewhere too."""
    alone = kinds.join(several, "anchor", "left_anti").filter("weight > 1")
    alone = alone.select("anchor", F.lit(anchor - length).alias("lo"), F.lit(1).alias("hi"), F.lit(0).cast("long").alias("core"), "block", F.lit(None).cast("binary").alias("data"), "lead", "windows", F.lit(True).alias("twice"))
    out = [scratch.write(alone.mapInArrow(_sorted_buckets(length), _RANGES).select("anchor", F.col("block").alias("origin"), "from", "to"), "repeats")]
    wanted = kinds.join(several, "anchor").groupBy("text_key").agg(F.collect_list(F.struct("anchor", "block", "start", "lead", "windows", "weight")).alias("wanted"))
    state = scratch.write(wanted.join(texts, "text_key").select("text", "wanted").mapInArrow(_slices(length, anchor), _STATE), "buckets")
    while True:
        # Blocks of different origins may be the same once cut: counted together, and sorted once.
        same = state.groupBy(*_BUCKET_KEY, "block").agg(F.sum("weight").alias("times"), F.first("data").alias("data"), F.first("lead").alias("lead"))
        same = scratch.write(same, "cut-blocks")
        size = scratch.write(same.groupBy(*_BUCKET_KEY).agg(F.count("*").alias("kinds"), F.max("times").alias("most")), "bucket-sizes")
        fits = size.filter((F.col("kinds") > 1) & (F.col("kinds") <= bucket) | (F.col("kinds") == 1) & (F.col("most") > 1)).drop("kinds", "most")
        found = same.join(fits, _BUCKET_KEY).select(*_BUCKET_KEY, "block", "data", "lead", (F.length("data") - (length - 1)).alias("windows"), (F.col("times") > 1).alias("twice")).repartition(*_BUCKET_KEY).sortWithinPartitions(*_BUCKET_KEY, "block")
        ranges = found.mapInArrow(_sorted_buckets(length), _RANGES)
        origins = state.select(*_BUCKET_KEY, "block", "origin")
        out.append(scratch.write(ranges.join(origins, [*_BUCKET_KEY, "block"]).select("anchor", "origin", "from", "to"), "repeats"))
        large = size.filter(F.col("kinds") > bucket).drop("kinds", "most")
        if large.isEmpty():
            return out
        halved = scratch.write(state.join(large, _BUCKET_KEY).mapInArrow(_halves(length), _STATE), "buckets")
        scratch.drop(state, same, size)
        state = halved


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, bucket: int = BUCKET, texts_too: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, changed, spans (and ``kept``, the remaining bytes of texts that lost a part, if ``texts_too``).

    Removed is each byte covered by a string of ``length`` bytes that also starts anywhere
    else, in the same document too; overlaps count, and strings are judged on the input.
    ``n_kept`` are the bytes that remain, ``changed`` says whether any was removed, and
    ``spans`` lists the removed runs as start:end in bytes, end exclusive, comma-joined.
    Matches never cross documents.  Null counts as empty; texts shorter than ``length``
    lose nothing.  Of repeated rows and equal texts every one loses all its bytes if it has
    ``length`` of them.  Columns other than doc_id and text are not read.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    own = F.coalesce("text", F.lit(""))
    whole = scratch.write(docs.select("doc_id", _text_key().alias("text_key"), F.octet_length(own).cast("long").alias("n_bytes"), F.sha2(own, 256).alias("sha")), "texts")
    # A text that stands twice goes as a whole.
    copied = scratch.write(whole.filter(F.col("n_bytes") >= length).groupBy("text_key").agg(F.count("*").alias("copies")).filter("copies > 1").select(F.col("text_key").alias("__copied")), "copied")
    occurrences = scratch.write(_occurrences(docs, length, anchor), "anchors")
    # Written, as are the other key tables below: a join of two plain shuffles is one whose hot keys Spark can split.
    common = scratch.write(occurrences.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "common-anchors")
    # A copied text's blocks stand there once for each task that met it, and here once.
    shared = scratch.write(occurrences.join(common, "anchor").distinct(), "shared-anchors")
    scratch.drop(occurrences, common)
    kinds = scratch.write(shared.groupBy("anchor", "block").agg(F.count("*").alias("weight"), F.min(F.struct("text_key", "start", "lead", "windows")).alias("r")).select("anchor", "block", "weight", "r.*"), "blocks")
    several = scratch.write(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor"), "mixed-anchors")
    # Only texts that stand once are cut; copied ones only show what is repeated in them.
    single = scratch.write(shared.join(copied, F.col("text_key") == F.col("__copied"), "left_anti").select("anchor", F.col("block").alias("origin"), "text_key", (F.col("start") + F.col("lead")).alias("place")), "single-texts")
    wanted = scratch.write(single.select("text_key").union(kinds.join(several, "anchor").select("text_key")).distinct(), "text-keys")
    texts = _bloom_hits(docs, wanted).join(wanted, "text_key").groupBy("text_key").agg(F.first("text").alias("text"))
    texts = scratch.write(texts, "shared-texts")
    repeats = None
    for part in _repeats(kinds, several, texts, length, anchor, bucket, scratch):
        repeats = part if repeats is None else repeats.union(part)
    spans = single.join(repeats, ["anchor", "origin"]).groupBy("text_key").agg(F.collect_list(F.struct((F.col("place") + F.col("from")).alias("from"), (F.col("place") + F.col("to")).alias("to"))).alias("spans"))
    work = spans.join(texts, "text_key").select("text_key", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            out = []
            for key, text, starts in zip(*(batch.column(c) for c in ("text_key", "text", "spans")), strict=True):
                data = text.as_py().encode()
                merged: list[list[int]] = []
                for a, b in sorted((s["from"], s["to"] - 1 + length) for s in starts.as_py()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                left, last = [], 0
                for a, b in merged:
                    left.append(data[last:a])
                    last = b
                kept = b"".join([*left, data[last:]])
                out.append((key.as_py(), sum(b - a for a, b in merged), len(merged), hashlib.sha256(kept).hexdigest(), ",".join(f"{a}:{b}" for a, b in merged), kept if texts_too else None))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["__key", "__removed", "__spans", "__sha", "__list", "kept"])

    result = work.mapInArrow(cut, "__key binary, __removed long, __spans long, __sha string, __list string, kept binary")
    if not texts_too:
        result = result.drop("kept")
    cuts = scratch.write(result.join(copied, F.col("__key") == F.col("__copied"), "full").withColumn("__text", F.coalesce("__key", "__copied")), "cuts")
    scratch.keep(whole, cuts)
    joined = whole.join(cuts, whole["text_key"] == F.col("__text"), "left")
    gone = F.col("__copied").isNotNull()
    none = F.lit(0).cast("long")
    removed = F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("__removed", none))
    columns = [
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("__spans", none)).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("__sha", "sha")).alias("kept_sha256"),
        (F.col("n_bytes") - removed).alias("n_kept"),
        (removed > 0).alias("changed"),
        F.when(gone, F.concat(F.lit("0:"), F.col("n_bytes"))).otherwise(F.coalesce("__list", F.lit(""))).alias("spans"),
    ]
    return joined.select(*columns, *([F.when(~gone, F.col("kept")).alias("kept")] if texts_too else []))
