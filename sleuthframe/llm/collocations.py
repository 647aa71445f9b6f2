"""Phrase collocations: word sequences that stand together far more often than their parts explain.

1. Texts are cut into pieces at punctuation; equal pieces of a language are counted once with
   their multiplicity (map-side combine, one shuffle of distinct pieces) and written.
2. A task turns its distinct pieces into n-grams that weigh their piece's multiplicity,
   combined chunk by chunk, sorted, and dealt to buckets by hash: a chunk sends each bucket one
   compressed Arrow stream, so the shuffle moves a few bytes an n-gram.  Each bucket is added up
   by duckdb under a stated memory limit, beyond which it spills to the task's own temporary
   folder.  Only phrases that are frequent enough leave the bucket.  Words and pairs come
   first; a longer phrase is frequent only if both phrases of one word less in it are, so each
   further length leaves out, before the shuffle, what a Bloom filter of those shows to be rare
   (sized by their number, 32 MB at most; with more of them nothing is left out).
3. Every candidate sends a request to the bucket of each part whose count it needs; the
   answers are gathered by candidate.  Longer candidates tell the shorter ones inside them
   their count the same way, so no task needs a table of all counts.
4. The best of each language are taken from parts of it first, then from what these leave.

Counts and scores are whole numbers; products are decimals of 38 digits, exact for up to
10^15 occurrences of a phrase.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .durable import Scratch, free

LANG_OF_NONE = "und"
CUTS = "[.,;:!?\\x0A-\\x0D]+"
#: Bytes of pieces combined at once, and what duckdb may hold of a bucket before it spills.
CHUNK, BUCKET_MEMORY = 4 << 20, "128MB"
#: Buckets for each shuffle partition of the session: several are one task, and a bucket is never two.
BUCKETS = 4
#: Bits of the filter for each phrase, places that a phrase has in it, and its most bits (32 MB).
BLOOM_BITS, BLOOM_PLACES, BLOOM_MOST = 16, 4, 1 << 28
#: Parts of a language from which the best are taken first.
_DEALT = 64

_GRAMS = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, m): distinct pieces, their words joined by single spaces, and how often each occurs."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = docs.select(F.coalesce("lang", F.lit(LANG_OF_NONE)).alias("lang"), F.explode(F.split(lower, CUTS)).alias("piece"))
    plain = F.trim(F.regexp_replace("piece", "[ \\t]+", " "))
    return cut.select("lang", plain.alias("piece")).filter("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys' first places, their sums of weights, exact, and each key's number among the distinct ones in order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[starts], np.add.reduceat(weights[order], starts), number


def _compact(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an array of strings; they hold all bytes of ``data`` but spaces."""
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)), pa.py_buffer(data[data != 32].tobytes()))


def _salt(names: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    data, off = B.text_buffers(names)
    return B.span_hash(B.prefix_hash(data), off[:-1], off[1:])


def _append(hashed: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Hash of a phrase with one more word."""
    return B.mix(hashed * np.uint64(B.BASE) + salt)


def phrase_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """The hash of each (lang, phrase), as ``weighted_ngrams`` makes it."""
    out, k = _salt(batch.column("lang")), batch.column("k").to_numpy()
    for size in np.unique(k[k > 0]).tolist():
        rows = np.flatnonzero(k == size)
        salt = _salt(pc.split_pattern(batch.column("phrase").take(pa.array(rows)), " ").flatten()).reshape(-1, size)
        for i in range(size):
            out[rows] = _append(out[rows], salt[:, i])
    return out


class Sieve:
    """A Bloom filter of phrases' hashes; None as bits lets everything pass."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits

    @staticmethod
    def places(hashed: np.ndarray, size: int) -> list[np.ndarray]:
        return [(B.mix(hashed + np.uint64(i + 1)) & np.uint64(size - 1)).astype(np.int64) for i in range(BLOOM_PLACES)]

    def passes(self, hashed: np.ndarray) -> np.ndarray:
        good = np.ones(len(hashed), bool)
        if self.bits is not None:
            for at in self.places(hashed, 8 * len(self.bits)):
                good &= (self.bits[at >> 3] >> (at & 7)) & 1 > 0
        return good


def weighted_ngrams(lang: pa.Array, piece: pa.Array, m: np.ndarray, most: int, sieve: Sieve | None = None) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Hashes and rows (lang, k, phrase, f) of the phrases of some pieces, each phrase once a chunk, sorted by words.

    Phrases of 1 to ``most`` words, and k = 0 for the number of a language's words; with a sieve,
    only those of ``most`` words whose two parts of one word less pass it.
    """
    langs = pc.dictionary_encode(lang)
    codes, names = langs.indices.to_numpy().astype(np.int64), langs.dictionary
    tongues = _salt(names)
    for lo, hi, data, off in B.chunks(piece, CHUNK):
        starts, ends, first = B.words(data, off)
        if not len(starts):
            continue
        per = np.diff(first)
        coded = _compact(data, starts, ends).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        words, size = coded.dictionary.take(pa.array(order)).cast(pa.string()), len(order)
        rank = np.empty(size, np.int64)
        rank[order] = np.arange(size)
        salt, word = _salt(words), rank[coded.indices.to_numpy()]
        left, weights = np.repeat(first[1:], per) - np.arange(len(starts)), np.repeat(m[lo:hi], per)
        tongue = np.repeat(codes[lo:hi], per)

        def rows(k: int, where: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, pa.RecordBatch]:
            hashed, parts = tongues[tongue[where]], []  # noqa: B023
            for i in range(k):
                hashed = _append(hashed, salt[word[where + i]])  # noqa: B023
                parts.append(words.take(pa.array(word[where + i])))  # noqa: B023
            phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0] if k else pa.array([""] * len(where), pa.string())
            return hashed, pa.RecordBatch.from_arrays([names.take(pa.array(tongue[where])), pa.array(np.full(len(where), k, np.int32)), phrase, pa.array(total)], schema=_GRAMS)  # noqa: B023

        if sieve is None:
            at, total, _ = _sums(tongue, weights)
            yield rows(0, at, total)
        # A word's number is that of (language, word), so phrases need no language of their own.
        single, kinds = tongue * size + word, len(names) * size
        places, number = np.arange(len(starts)), None
        if sieve is not None:
            hashed = tongues[tongue]
            for i in range(most - 1):
                hashed = _append(hashed, salt[word[np.minimum(places + i, len(places) - 1)]])
            good = sieve.passes(hashed)
            places = places[:-1][good[:-1] & good[1:] & (left[:-1] >= most)]
        for k in range(1, most + 1):
            if k > 1:
                inside = left[places] >= k
                places, number = places[inside], number[inside]
            if not len(places):
                break
            at, total, number = _sums(single[places] if k == 1 else number * kinds + single[places + k - 1], weights[places])
            if sieve is None or k == most:
                yield rows(k, places[at], total)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches together as chunks of about ``CHUNK`` bytes: phrases are combined over more pieces."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.get_total_buffer_size()
        if size >= CHUNK:
            yield pa.Table.from_batches(some).combine_chunks()
            some, size = [], 0
    if some:
        yield pa.Table.from_batches(some).combine_chunks()


def packed_ngrams(batches: Iterator[pa.RecordBatch], most: int, buckets: int, sieve: Sieve | None = None) -> Iterator[pa.RecordBatch]:
    """(bucket, grams): the weighted n-grams of pieces as one compressed Arrow stream for each chunk, length and bucket."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for table in _gathered(batches):
        if not table.num_rows:
            continue
        lang, piece = (table.column(c).combine_chunks() for c in ("lang", "piece"))
        for hashed, grams in weighted_ngrams(lang, piece, table.column("m").to_numpy(), most, sieve):
            bucket = (hashed % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            grams = grams.take(pa.array(order))
            which, edges = np.unique(bucket[order], return_index=True)
            packed = []
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _GRAMS, options=options) as stream:
                    stream.write_batch(grams.slice(a, b - a))
                packed.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "grams"])
    B.release()


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for grams in batch.column("grams"):
            yield from pa.ipc.open_stream(grams.as_buffer())


def bucket_counts(batches: Iterator[pa.RecordBatch], least: int, memory: str = BUCKET_MEMORY) -> Iterator[pa.RecordBatch]:
    """Sums of one bucket's weighted n-grams and their hashes; those under ``least`` are left out but for the numbers of words."""
    import duckdb

    folder = tempfile.mkdtemp(prefix="bucket-")
    db = duckdb.connect(":memory:", config={"memory_limit": memory, "threads": "1", "temp_directory": folder, "preserve_insertion_order": "false"})
    try:
        grams = pa.RecordBatchReader.from_batches(_GRAMS, batches)  # noqa: F841  duckdb reads it by name
        found = db.sql(f"SELECT lang, k, phrase, CAST(sum(f) AS BIGINT) AS f FROM grams GROUP BY ALL HAVING sum(f) >= {int(least)} OR k = 0")
        for b in found.to_arrow_reader(50_000):
            counted = b.cast(_GRAMS)
            yield counted.append_column("h", pa.array(phrase_hashes(counted).view(np.int64)))
    finally:
        db.close()
        shutil.rmtree(folder, ignore_errors=True)
        B.release()


_COUNTS = "lang string, k int, phrase string, f long, h long"


def sieve_of(table: DataFrame, k: int) -> Sieve:
    """The filter of the counted phrases of ``k`` words, made in Spark as blocks of bits; none where it would pass its bound."""
    keys = table.filter(F.col("k") == k)
    n = max(keys.count(), 1)
    size = 1 << max(20, (BLOOM_BITS * n - 1).bit_length())
    if size > BLOOM_MOST:
        return Sieve(None)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in Sieve.places(batch.column("h").to_numpy().view(np.uint64), size):
                yield pa.RecordBatch.from_arrays([pa.array(at + 1)], names=["at"])

    blocks = keys.select("h").mapInArrow(places, "at long").groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros((size >> 15, 1 << 12), np.uint8)
    for r in blocks.collect():
        bits[r["block"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return Sieve(bits.ravel())


def counts(docs: DataFrame, least: int = 10, most: int = 3, memory: str = BUCKET_MEMORY) -> list[DataFrame]:
    """Written tables (lang, k, phrase, f, h): how often each phrase of 1 to ``most`` words occurs, if ``least`` times or more; k = 0 has the number of the language's words."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = scratch.write(pieces(docs), "pieces", compression="zstd")
    free(spark)
    out: list[DataFrame] = []
    for k in range(min(2, most), most + 1):
        shared = spark.sparkContext.broadcast(sieve_of(out[-1], k - 1)) if out else None

        def pack(batches: Iterator[pa.RecordBatch], k: int = k, shared=shared) -> Iterator[pa.RecordBatch]:
            yield from packed_ngrams(batches, k, buckets, shared and shared.value)

        dealt = distinct.mapInArrow(pack, "bucket int, grams binary").repartition("bucket")
        out.append(scratch.write(dealt.mapInArrow(lambda batches: bucket_counts(unpacked(batches), least, memory), _COUNTS), "counts"))
        free(spark)
    scratch.drop(distinct)
    return out


def _span(words: Column, start: int, size: int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _parts(k: int) -> list[Column]:
    """The requests of a phrase of ``k`` words: the two sides of each cut."""
    w = F.col("w")
    return [F.struct(F.lit(cut).alias("cut"), F.lit(side).alias("side"), part.alias("part")) for cut in range(1, k) for side, part in (("l", _span(w, 1, cut)), ("r", _span(w, cut + 1, k - cut)))]


def _inner(k: int) -> list[Column]:
    """The shorter phrases of two words or more inside one of ``k`` words."""
    return [_span(F.col("w"), start, size) for size in range(2, k) for start in range(1, k - size + 2)]


def _by_length(make, most: int, least: int = 2) -> Column:
    out = F.when(F.col("k") == least, F.array(*make(least)))
    for k in range(least + 1, most + 1):
        out = out.when(F.col("k") == k, F.array(*make(k)))
    return out


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(15,0)")


def scored(cuts: DataFrame) -> DataFrame:
    """``cuts`` (a, l, r, ...) plus ``score``, floor(1000000 * a * a / (l * r)), exact."""
    square = (_wide("a") * _wide("a") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    return cuts.withColumn("__s", square).withColumn("__p", (_wide("l") * _wide("r")).cast("decimal(38,0)")).withColumn("score", F.expr("__s div __p")).drop("__s", "__p")


def mine(docs: DataFrame, least: int = 10, most: int = 3, inside_percent: int = 50, best: int = 2000, memory: str = BUCKET_MEMORY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` collocations of each language.

    Pieces are what stands between characters of ``.,;:!?`` and line ends; their words are runs
    of anything but space and tab, A-Z in lower case.  A phrase of 2 to ``most`` words that occurs
    a >= ``least`` times is a candidate.  Cut after its first words, its sides occur l and r times,
    and the cut scores floor(1000000 * a * a / (l * r)); the lowest-scoring cut counts, of equal
    ones the first.  A candidate is left out if a longer candidate holds it and occurs at least
    ``inside_percent`` percent as often.  n is the number of words in the language.  Ranks go by
    score, then a, both descending, then by phrase in byte order.

    A null lang is ``und``, a null text empty.  Repeated rows count each; other columns, whatever
    their names, are not read.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    table = reduce(DataFrame.unionByName, counts(docs, least, most, memory))
    words = table.filter("k = 0").select(F.col("lang").alias("__lang"), F.col("f").alias("n"))
    found = table.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    asked = found.select("lang", "phrase", F.explode(_by_length(_parts, most)).alias("x")).select("lang", "phrase", "x.*")
    known = table.filter(f"k between 1 and {most - 1}").select(F.col("lang").alias("__lang"), F.col("phrase").alias("__part"), "f")
    answers = scratch.write(asked.join(known, (F.col("lang") == F.col("__lang")) & (F.col("part") == F.col("__part"))).select("lang", "phrase", "cut", "side", "f"), "answers")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f"))).alias(s)
    cuts = answers.groupBy("lang", "phrase", "cut").agg(side("l"), side("r")).join(found.select("lang", "phrase", "a"), ["lang", "phrase"])
    best_cut = F.min(F.struct("score", "cut", "l", "r")).alias("b")
    found_best = scored(cuts).groupBy("lang", "phrase", "a").agg(best_cut).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    if most > 2:
        inner = found.filter("k > 2").select("lang", F.explode(_by_length(_inner, most, 3)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        known_longer = found_best.join(inner, ["lang", "phrase"], "left")
        found_best = known_longer.filter(F.coalesce(F.lit(100) * _wide("longer") < F.lit(inside_percent) * _wide("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_DEALT))).orderBy(*order)
    some = found_best.withColumn("rank", F.row_number().over(dealt)).filter(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    return ranked.join(words, F.col("lang") == F.col("__lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine_sql(least: int = 10, most: int = 3, inside_percent: int = 50, best: int = 2000) -> str:
    """The same in DuckDB's SQL over ``documents``."""
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase, m FROM (SELECT lang, w, m, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces)" for k in range(1, most + 1))
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, a, {cut} AS cut, array_to_string(w[1:{cut}], ' ') AS lp, array_to_string(w[{cut + 1}:], ' ') AS rp FROM found WHERE k = {k}" for k in range(2, most + 1) for cut in range(1, k))
    inner = " UNION ALL ".join(f"SELECT lang, array_to_string(w[{s}:{s + size - 1}], ' ') AS phrase, a FROM found WHERE k = {k}" for k in range(3, most + 1) for size in range(2, k) for s in range(1, k - size + 2)) or "SELECT lang, phrase, a FROM found WHERE false"
    return f"""WITH texts AS (SELECT coalesce(lang, '{LANG_OF_NONE}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{CUTS}')) AS piece FROM documents),
    pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w, count(*) AS m FROM texts GROUP BY 1, 2),
    total AS (SELECT lang, CAST(sum(len(w) * m) AS BIGINT) AS n FROM pieces GROUP BY lang),
    counts AS (SELECT lang, k, phrase, CAST(sum(m) AS BIGINT) AS a FROM ({grams}) GROUP BY ALL HAVING sum(m) >= {least}),
    found AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
    cuts AS (SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.a AS HUGEINT) * y.a) AS score FROM ({cuts}) c JOIN counts x ON x.lang = c.lang AND x.phrase = c.lp JOIN counts y ON y.lang = c.lang AND y.phrase = c.rp),
    longer AS (SELECT lang, phrase, max(a) AS most FROM ({inner}) GROUP BY ALL),
    scored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM cuts) WHERE nth = 1),
    ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank FROM scored s LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < {inside_percent} * s.a)
    SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= {best}"""
