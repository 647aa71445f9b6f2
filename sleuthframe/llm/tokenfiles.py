"""Token-ID files: Parquet list columns in document order, made for selective reads.

Layout of a folder:

* ``tokens``: a row a document (doc_id, part, first, n_tokens, columns asked for, ids
  array<int>), sorted by doc_id over the files.  ``part`` is the file's number in that order,
  ``first`` the number of ids before the document in its file.
* ``parts``: a row a file (part, base, n_tokens, n_docs, least_id, most_id); ``base`` is the
  number of ids in all files before, so a document starts at base + first.

Ids are dictionary-encoded (one bit-packed index an id) or delta-encoded (version 2 pages);
row groups and pages have a stated size, and Parquet's page index holds their bounds.  A read
of metadata fetches only the small columns; a read of some documents or of a span of ids
skips files by ``parts``, then row groups and pages by their bounds.

Texts are dealt by range of doc_id and sorted, then encoded where they lie: one shuffle of
texts.  Encoding cuts a text only where the vocabulary's own rule always ends a pre-token, and
encodes each distinct piece of a chunk once with the tokenizers library; recent pieces are
remembered up to a bound.  A piece that is plainly one pre-token (letters after a space or
none) goes straight to the library's model, others through all of its steps.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytesops as B

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
END = 2
#: Bytes of a row group and of a page before compression.
ROW_GROUP, PAGE = 32 << 20, 128 << 10
#: Bytes of text worked on at once, distinct pieces after which the older half is forgotten, and characters of the longest one remembered.
CHUNK, CACHED, CACHED_BYTES = 4 << 20, 250_000, 48

_VISIBLE = np.ones(256, bool)
_VISIBLE[:33] = _VISIBLE[127] = False
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_MARK = _VISIBLE & ~_LETTER
_MARK[128:] = False
#: Lead bytes of all characters outside ASCII that are white space, with the bytes that follow.
_WIDE = ((0xC2, 1), (0xE1, 2), (0xE2, 2), (0xE3, 2))
#: Letters with the lead byte 0xC3 are all that have it but these (the signs of times and division).
_LATIN, _SIGNS = 0xC3, (0x97, 0xB7)


def piece_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces start: at texts, and where a pre-token surely ends.

    That is before a single space between visible characters, on both sides of such a single
    line feed, and between letters or digits and ASCII punctuation, but for letters after an
    apostrophe.  Characters that might be white space or no letters count as neither.
    """
    n = len(data)
    visible, letter = _VISIBLE[data], _LETTER[data]
    for lead, more in _WIDE:
        at = np.flatnonzero(data == lead)
        for k in range(more + 1):
            visible[at[at + k < n] + k] = False
    at = np.flatnonzero(data[:-1] == _LATIN) if n else np.zeros(0, np.int64)
    at = at[~np.isin(data[at + 1], _SIGNS)]
    letter[at] = letter[at + 1] = True
    mark = _MARK[data]
    cut = np.zeros(n, bool)
    if n > 1:
        cut[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:] & (data[:-1] != 39))
    if n > 2:
        between = visible[:-2] & visible[2:]
        line = between & (data[1:-1] == 10)
        cut[1:-1] |= line | (between & (data[1:-1] == 32))
        cut[2:] |= line
    # What stands at the edge of a text isn't next to the other text.
    first, last = off[:-1], off[1:] - 1
    full = first <= last
    first, last = first[full], last[full]
    cut[last[data[last] == 32]] = False
    cut[first[first + 1 < n] + 1] &= ~np.isin(data[first[first + 1 < n]], (10, 32))
    cut[last[data[last] == 10]] = False
    cut[first] = True
    return np.flatnonzero(cut)


#: The byte-level alphabet: printable bytes stand for themselves, others for characters from U+0100 on, in order.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: b for b in _PRINTS} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINTS))}
_ONE = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")


class Encoder:
    """Ids of texts by a byte-level vocabulary of the tokenizers library; special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        #: Ids of recent pieces as 32-bit integers, and those of the generation before.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        tokenize, one = self.tokenizer.model.tokenize, _ONE.fullmatch
        out: list[bytes] = [b""] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if one(t):
                out[i] = array("i", [x.id for x in tokenize(t.encode().decode("latin-1").translate(_ALPHABET))]).tobytes()
            else:
                rest.append(i)
        for lo in range(0, len(rest), 4096):
            some = rest[lo : lo + 4096]
            for i, e in zip(some, self.batch([texts[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = array("i", e.ids).tobytes()
        return out

    def pieces(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = [known.get(t) or older.get(t) for t in texts]
        new = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(new, self._encode([texts[i] for i in new]), strict=True):
            out[i] = ids
        known.update((t, ids) for t, ids in zip(texts, out, strict=True) if len(t) <= CACHED_BYTES)
        return out

    def chunk(self, data: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text), ``end`` after each text."""
        starts = piece_starts(data, off)
        bounds = np.append(starts, len(data)).astype(np.int64)
        strings = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        coded = strings.dictionary_encode()
        ids = self.pieces(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), np.int32)
        each = size[index]
        total = np.concatenate(([0], np.cumsum(each)))
        first = np.searchsorted(starts, off)
        out = np.full(total[-1] + len(off) - 1, end, np.int32)
        # Places fit 32 bits in a chunk, and are most of its memory.
        kind = np.int32 if len(out) < 1 << 31 else np.int64
        text = np.repeat(np.arange(len(off) - 1, dtype=kind), np.diff(first))
        place = np.arange(total[-1], dtype=kind)
        source = np.repeat(((np.cumsum(size) - size)[index] - total[:-1]).astype(kind), each)
        source += place
        place += np.repeat(text, each)
        out[place] = flat[source]
        return out, np.diff(total[first]) + 1


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, keep: Sequence[str] = (), end: int = END, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, part, first, n_tokens, keep..., ids) of ``docs`` in its order within each partition, which is the part."""
    path = f"{tokenizers}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, first = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, data, off in B.chunks(batch.column("text"), CHUNK):
                ids, n = encoder.chunk(data, off, end)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))
                rows = batch.slice(lo, hi - lo)
                place = [pa.array(np.full(hi - lo, part), pa.int32()), pa.array(first + ends - n, pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *place, *(rows.column(c) for c in keep), lists], names=["doc_id", "part", "first", "n_tokens", *keep, "ids"])
                first += int(ends[-1]) if len(ends) else 0
        B.release()

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", *keep)}
    schema = ", ".join([f"doc_id {kinds['doc_id']}", "part int", "first long", "n_tokens long", *(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>"])
    return docs.select("doc_id", "text", *keep).mapInArrow(run, schema)


def write(docs: DataFrame, path: str, keep: Sequence[str] = (), encoding: str = "dictionary", end: int = END, row_group: int = ROW_GROUP, page: int = PAGE, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> None:
    """Encodes whole texts and writes the folder described above, ids in ascending order of doc_id.

    A null text is empty, and every document ends in the id ``end``, so an empty one has one
    id.  Null ids come first; rows of one doc_id are ordered by the hash of their text, so a
    busy doc_id is many files; rows equal in both stay together in one task, which streams
    them.  An empty table gives empty tables.  ``keep`` names further columns to store; others,
    whatever their names, are not read.  ``encoding`` of the ids is dictionary or delta.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"no such encoding of ids: {encoding}")
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first()]
    dealt = docs.select("doc_id", "text", *keep).repartitionByRange(*order[:2]).sortWithinPartitions(*order, *keep)
    options = {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
        "parquet.enable.dictionary#first": "false",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.dictionary.page.size": str(2 << 20),
        "parquet.block.size": str(row_group),
        "parquet.page.size": str(page),
        "parquet.page.row.count.limit": "1000",
        "compression": "zstd",
    }
    encode(dealt, keep, end, tokenizers, vocabulary).write.options(**options).parquet(f"{path}/tokens")
    # Parts are as many as files, so one task can add them up.
    parts = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.min("doc_id").alias("least_id"), F.max("doc_id").alias("most_id"))
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts.withColumn("base", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/parts")


def parts(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder: (part, n_tokens, n_docs, least_id, most_id, base)."""
    return spark.read.parquet(f"{path}/parts")


def _located(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` with ``start``; the table of files is as small as a listing."""
    return rows.join(files.select("part", "base"), "part").withColumn("start", F.col("base") + F.col("first")).drop("base", "part", "first")


def read(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, kept columns, ids, start) of all documents, or of those that ``where`` holds for; columns not selected are not read."""
    rows = spark.read.parquet(f"{path}/tokens")
    return _located(rows if where is None else rows.filter(where), parts(spark, path))


def read_documents(spark: SparkSession, path: str, least, most) -> DataFrame:
    """Documents with least <= doc_id <= most: row groups and pages beyond are skipped by their bounds."""
    return read(spark, path, F.col("doc_id").between(least, most))


def read_span(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """(start, ids): ids at places begin <= i < end of the whole corpus, a row a document, cut to the span.

    Only files that meet the span are looked at, and in them only row groups and pages whose
    documents do.
    """
    met = parts(spark, path).filter((F.col("base") < end) & (F.col("base") + F.col("n_tokens") > begin)).select("part", "base").orderBy("part")
    # A span is read by one consumer at a time, so its files are few; their bounds go into the scan's filter.
    bounds = met.agg(F.min("part"), F.max("part"), F.min_by("base", "part"), F.max_by("base", "part")).first()
    rows = spark.read.parquet(f"{path}/tokens")
    if bounds[0] is None:
        return rows.select(F.lit(0).cast("long").alias("start"), "ids").limit(0)
    low, high, low_base, high_base = bounds
    wanted = F.col("part").between(low, high) & ((F.col("part") < high) | (F.col("first") < end - high_base)) & ((F.col("part") > low) | (F.col("first") + F.col("n_tokens") > begin - low_base))
    rows = _located(rows.filter(wanted), parts(spark, path).filter(F.col("part").between(low, high)))
    skip = F.greatest(F.lit(begin) - F.col("start"), F.lit(0)).cast("int")
    take = (F.least(F.lit(end), F.col("start") + F.col("n_tokens")) - F.col("start")).cast("int") - skip
    return rows.filter((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > begin)).select((F.col("start") + skip).alias("start"), F.slice("ids", skip + 1, take).alias("ids"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; the checksum is of the ids as little-endian 32-bit integers."""
    rows = spark.read.parquet(f"{path}/tokens").select("doc_id", "part", "first", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            off, values = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            sums = [zlib.crc32(values[a:b]) for a, b in itertools.pairwise(off.tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "first")), pa.array(np.diff(off), pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "part", "first", "n_tokens", "ids_crc32"])

    summed = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part int, first long, n_tokens long, ids_crc32 long")
    return _located(summed, parts(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
