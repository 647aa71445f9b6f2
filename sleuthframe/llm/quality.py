"""Quality rules: repetition and symbol counts, then tokeniser fertility bands.

Two public vocabularies measure each text: letters and digits per token under a piece
vocabulary and under a multilingual byte-level one, the share of the latter's tokens that are
parts of a character, and the entropy of windows of a fixed number of tokens, which doesn't
depend on the text's length.  A text that any measure puts outside the band of its language
(or, if it is mostly of another than Latin script, of that script) is rejected.  Prose in a
language has a steady fertility; mojibake, symbol noise, random letters, encoded data and
tables of fragments don't.

A measure has a noise side and, mostly, a far side.  Few letters a token is random letters,
encoded data and tables of fragments; a high byte share is mojibake; low entropy is repetition
and symbol noise.  Only these limits are fitted to the corpus (``bands_of``): over all documents
that pass the base rules, the median of the measure by language or script, and ``SPREADS``
robust deviations (quartile range / 1.349, at least ``FLOORS``) towards the noise.  A fitted
limit is averaged with the prior one of ``PRIORS`` as if that had been seen in ``PRIOR_ROWS``
documents, and never wider than the prior: a language that is mostly junk doesn't make junk
the norm.  The far sides stay at the prior, so that natural prose isn't noise in a corpus of
another kind of text: many letters a token at 5.5, high entropy beyond what a window can have,
which is no limit, as is a byte share of 0.  No labels are used.

Scale: one pass computes the measures; bands are quantile sketches over those narrow rows,
merged in Spark into a table of a row a language, which is joined: the most frequent ones
by broadcast, those beyond ``BROADCAST_BANDS`` by shuffle.  Distinct words of a chunk are tokenised
once and remembered by hash, up to ``CACHED_WORDS``; then the memory is emptied and filled
anew, which changes nothing but speed.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import bytesops as B
from .durable import materialize

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "piece_bpe_32k.model"
MULTI = "byte_bpe_multi_50k.tiktoken"
#: Tokens of a window of which entropy is taken: no text of 50 words has fewer.
WINDOW = 50
CACHED_WORDS = 400_000
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
#: Letters and digits by first byte, a script each: none; Latin; other alphabets of two bytes; those of India and South-East Asia; Chinese, Japanese, Korean.
_SCRIPT = np.full(256, -1, np.int8)
_SCRIPT[48:58] = 4
_SCRIPT[65:91] = _SCRIPT[97:123] = _SCRIPT[0xC3:0xCA] = 0
_SCRIPT[0xCD:0xE0] = 1
_SCRIPT[0xE0:0xE2] = 2
_SCRIPT[0xE3:0xEE] = 3


@dataclass(frozen=True)
class Band:
    """Limits of a clean text: least and most of each measure.

    Letters and digits per token under the piece vocabulary and under the multilingual one;
    share of tokens of the latter that are parts of a character; mean entropy, in bits, of
    windows of ``WINDOW`` of its tokens.
    """

    piece: tuple[float, float]
    multi: tuple[float, float]
    byte_share: tuple[float, float]
    entropy: tuple[float, float]


MEASURES = ("piece", "multi", "byte_share", "entropy")
#: Bands before any text is seen, wide enough for prose of any language: "" is for Latin script, "script N" for texts mostly of another script.
PRIORS: dict[str, Band] = {
    "": Band((1.58, 5.5), (1.70, 5.5), (0.0, 0.05), (4.70, 5.65)),
    "script 1": Band((0.0, 99.0), (1.0, 5.5), (0.0, 0.20), (4.40, 5.65)),
    "script 2": Band((0.0, 99.0), (0.3, 5.5), (0.0, 0.80), (3.60, 5.65)),
    "script 3": Band((0.0, 99.0), (0.4, 4.0), (0.0, 0.60), (4.40, 5.65)),
}
#: Robust deviations from the median to a limit; documents that a prior limit counts for.
SPREADS, PRIOR_ROWS = 7.0, 30
#: Least deviation of each measure, as a share of its median; of the byte share as it is.
FLOORS = {"piece": 0.025, "multi": 0.025, "byte_share": 0.005, "entropy": 0.01}
#: Rows of the table of bands that are broadcast, those of the most frequent languages; the others are joined by shuffle.
BROADCAST_BANDS = 10_000
#: Fitted limits: measure, side (0 least, 1 most); the noise that each is against stands above.
FITTED = (("piece", 0), ("multi", 0), ("byte_share", 1), ("entropy", 0))
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens", "token_entropy")
#: Measures of the multilingual vocabulary, and letters and script.
MORE = ("n_letters", "script", "n_multi_tokens", "n_multi_byte_tokens", "window_entropy")


class Fertility:
    """Token ids of distinct words under a SentencePiece vocabulary, in flat arrays."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.clear()

    def encode(self, words: list[str]) -> list[list[int]]:
        return self.model.encode(words, num_threads=1)

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1, np.int64)

    def words(self, hashes: np.ndarray, texts) -> np.ndarray:
        """Numbers of words by hash; texts(i) gives the i-th word, asked for new ones only."""
        if len(self.known) > CACHED_WORDS:
            self.clear()
        got = list(map(self.known.get, hashes.tolist()))
        new = [i for i, x in enumerate(got) if x is None]
        if new:
            tokens = self.encode(texts(new))
            base = len(self.known)
            for k, i in enumerate(new):
                got[i] = base + k
            self.known.update(zip(hashes[new].tolist(), range(base, base + len(new)), strict=True))
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            ends = self.first[-1] + np.cumsum(sizes)
            if ends[-1] > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(int(ends[-1]) - len(self.ids), len(self.ids)), np.int32)])
            self.ids[self.first[-1] : ends[-1]] = np.fromiter((t for w in tokens for t in w), np.int32, int(sizes.sum()))
            self.first = np.concatenate([self.first, ends])
        return np.array(got, np.int64)


class ByteFertility(Fertility):
    """The same under a byte-level vocabulary of ranks; words are tokenised as after a space.  Byte tokens are those that are no whole characters."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.zeros(max(ranks.values()) + 1, bool)
        for piece, i in ranks.items():
            try:
                piece.decode()
            except UnicodeDecodeError:
                self.is_byte[i] = True
        self.clear()

    def encode(self, words: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(" " + w) for w in words]


@functools.lru_cache(maxsize=4)
def fertility(path: str) -> Fertility:
    return ByteFertility(path) if path.endswith(".tiktoken") else Fertility(path)


def _per_text(cumulated: np.ndarray, off: np.ndarray) -> np.ndarray:
    return cumulated[off[1:]] - cumulated[off[:-1]]


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])


def base_features(data: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], tuple]:
    """Base columns of each text of a chunk, and (starts, ends, first words, word hashes)."""
    n = len(off) - 1
    starts, ends, first = B.words(data, off)
    prefix = B.prefix_hash(data)
    hashed = B.span_hash(prefix, starts, ends)
    out = {"n_words": np.diff(first)}
    lead = B._IS_WORD[data] & ((data & 0xC0) != 0x80)
    out["word_chars"] = _per_text(_sums(lead), off)
    out["n_symbols"] = _per_text(_sums(_SYMBOL[data]), off)
    kind = _SCRIPT[data]
    out["n_letters"] = _per_text(_sums(kind >= 0), off)
    out["script"] = np.argmax(np.stack([_per_text(_sums(kind == k), off) for k in range(4)]), axis=0)
    ls, le, lfirst = B.lines(data, off)
    worded = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    doc = np.repeat(np.arange(n), np.diff(lfirst))[worded]
    lh = B.span_hash(prefix, ls[worded], le[worded])
    order = np.lexsort((lh, doc))
    d, h = doc[order], lh[order]
    again = np.zeros(len(d), bool)
    again[1:] = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
    out["n_dup_lines"] = np.bincount(d[again], minlength=n).astype(np.int64)
    covered = np.zeros(len(hashed), bool)
    three = B.grams(hashed, 3)
    if len(three):
        of = np.repeat(np.arange(n), np.diff(first))
        inside = of[2:] == of[:-2]
        at = np.flatnonzero(inside)
        key = B.mix(three[at] + of[at].astype(np.uint64) * np.uint64(B.BASE))
        order = np.argsort(key, kind="stable")
        s = key[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        for k in range(3):
            covered[hit + k] = True
    out["n_repeat_words"] = _per_text(_sums(covered), first)
    return out, (starts, ends, first, hashed)


def token_features(data: np.ndarray, spans: tuple, n: int, vocabulary: Fertility) -> dict[str, np.ndarray]:
    """Tokens, byte-fallback tokens, token entropy and its mean over windows (bits) of each text; words are tokenised one by one."""
    starts, ends, first, hashed = spans
    unique, at, back = np.unique(hashed, return_index=True, return_inverse=True)
    text = data.tobytes()
    number = vocabulary.words(unique, lambda new: [text[starts[at[i]] : ends[at[i]]].decode("utf-8", "replace") for i in new])
    lo, size = vocabulary.first[number], vocabulary.first[number + 1] - vocabulary.first[number]
    per_word = size[back]
    tokens = _sums(per_word)
    out = {"n_tokens": _per_text(tokens, first)}
    pick = np.repeat(lo[back] - tokens[:-1], per_word) + np.arange(tokens[-1])
    ids = vocabulary.ids[pick]
    doc = np.repeat(np.arange(n), out["n_tokens"])
    out["n_byte_tokens"] = np.bincount(doc, weights=vocabulary.is_byte[ids], minlength=n).astype(np.int64)
    key = np.sort(doc * (1 << 20) + ids)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([edge, [len(key)]])).astype(float)
    of = key[edge] >> 20
    total = out["n_tokens"].astype(float)
    share = count / total[of] if len(of) else count
    out["token_entropy"] = np.bincount(of, weights=-share * np.log2(share), minlength=n) if len(of) else np.zeros(n)
    out["window_entropy"] = _window_entropy(ids, out["n_tokens"])
    return out


def _window_entropy(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean entropy (bits) of each text's windows of ``WINDOW`` tokens, the last of which ends with the text; fewer tokens are one window."""
    ends = np.cumsum(sizes)
    n = -(-sizes // WINDOW)
    of = np.repeat(np.arange(len(sizes)), n)
    start = (ends - sizes)[of] + np.minimum((np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW, np.maximum(sizes[of] - WINDOW, 0))
    width = np.minimum(sizes[of], WINDOW)
    number = np.repeat(np.arange(len(of)), width)
    at = np.arange(len(number)) + np.repeat(start - (np.cumsum(width) - width), width)
    key, count = np.unique((number << 20) + ids[at], return_counts=True)
    window = key >> 20
    share = count / width[window]
    total = np.bincount(of[window], weights=-share * np.log2(share), minlength=len(sizes)) if len(of) else np.zeros(len(sizes))
    return total / np.maximum(n, 1)


def measures(mark: str = "") -> dict[str, Column]:
    """The measures of ``MEASURES`` from the columns of features."""
    c = lambda k: F.col(mark + k)
    tokens, multi = F.greatest(c("n_tokens"), F.lit(1)), F.greatest(c("n_multi_tokens"), F.lit(1))
    return {"piece": c("n_letters") / tokens, "multi": c("n_letters") / multi, "byte_share": c("n_multi_byte_tokens") / multi, "entropy": c("window_entropy")}


def _base_failed(mark: str = "") -> Column:
    return (F.col(mark + "n_words") < 50) | (100 * F.col(mark + "n_repeat_words") > 50 * F.col(mark + "n_words"))


def band_key(lang: Column, script: Column) -> Column:
    """Whose band a text has: that of its script if it isn't Latin, else of its language."""
    return F.when(script > 0, F.concat(F.lit("script "), script)).otherwise(F.coalesce(lang, F.lit("")))


def _prior(key: Column, measure: str, side: int) -> Column:
    """The prior limit of a band; languages have that of Latin script."""
    out = F.lit(float(getattr(PRIORS[""], measure)[side]))
    for name, band in PRIORS.items():
        out = F.when(key == name, float(getattr(band, measure)[side])).otherwise(out)
    return out


def bands_of(measured: DataFrame, lang: Column, mark: str = "", spreads: float = SPREADS, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """(key, n, <measure>_least, <measure>_most): the bands of the languages and scripts of the texts, fitted to all that pass the base rules."""
    good = measured.filter(~_base_failed(mark)).select(band_key(lang, F.col(mark + "script")).alias("key"), *[v.alias(k) for k, v in measures(mark).items()])
    table = good.groupBy("key").agg(F.count("*").alias("n"), *[F.percentile_approx(k, [0.25, 0.5, 0.75], 10_000).alias(k) for k in MEASURES])
    limits = []
    for m in MEASURES:
        q = [F.col(m)[i] for i in range(3)]
        spread = F.greatest((q[2] - q[0]) / 1.349, F.lit(FLOORS[m]) * (F.lit(1.0) if m == "byte_share" else q[1]))
        for side, name in enumerate(("least", "most")):
            prior = _prior(F.col("key"), m, side)
            fitted = (F.col("n") * (q[1] + (2 * side - 1) * spreads * spread) + prior_rows * prior) / (F.col("n") + prior_rows)
            limits.append(((F.least if side else F.greatest)(fitted, prior) if (m, side) in FITTED else prior).alias(f"{m}_{name}"))
    return table.select("key", "n", *limits)


def band_table(spark: SparkSession, bands: Mapping[str, Band]) -> DataFrame:
    """Given bands as such a table; their number is that of the caller's own mapping."""
    names = [f"{m}_{side}" for m in MEASURES for side in ("least", "most")]
    rows = [(k, 0, *[float(x) for m in MEASURES for x in getattr(b, m)]) for k, b in bands.items()]
    return spark.createDataFrame(rows, "key string, n long, " + ", ".join(f"{n} double" for n in names))


def _outside(mark: str, bands: DataFrame, measured: DataFrame, lang: Column) -> DataFrame:
    """``measured`` plus ``__out``: comma-joined measures that are out of their band; a key without a band has its prior."""
    keyed = measured.withColumn("__k", band_key(lang, F.col(mark + "script")))
    limits = bands.select(F.col("key").alias("__key"), *[F.col(f"{m}_{side}").alias(f"__{m}_{side}") for m in MEASURES for side in ("least", "most")], F.col("n").alias("__n"))
    if limits.limit(BROADCAST_BANDS + 1).count() <= BROADCAST_BANDS:
        joined = keyed.join(F.broadcast(limits), F.col("__k") == F.col("__key"), "left")
    else:
        # Few languages hold most texts: theirs stay where they are, only the others move.
        often = limits.orderBy(F.desc("__n"), "__key").limit(BROADCAST_BANDS)
        first = keyed.join(F.broadcast(often), F.col("__k") == F.col("__key"), "left")
        rare = first.filter("__key is null").select(*keyed.columns)
        joined = first.filter("__key is not null").unionByName(rare.join(limits, F.col("__k") == F.col("__key"), "left"))
    out = []
    for m, value in measures(mark).items():
        least, most = (F.coalesce(F.col(f"__{m}_{side}"), _prior(F.col("__k"), m, i)) for i, side in enumerate(("least", "most")))
        out.append(F.when((value < least) | (value > most), m))
    return joined.withColumn("__out", F.concat_ws(",", *out)).drop("__k", *limits.columns)


def features(column: pa.Array, vocabulary: Fertility, multi: Fertility | None = None) -> dict[str, np.ndarray]:
    """All features of a column of texts, those of ``MORE`` if there is a multilingual vocabulary; a null text has no words."""
    parts: dict[str, list[np.ndarray]] = {k: [np.zeros(0, np.int64)] for k in FEATURES + (MORE if multi else ())}
    for lo, hi, data, off in B.chunks(column):
        found, spans = base_features(data, off)
        found |= token_features(data, spans, hi - lo, vocabulary)
        if multi:
            more = token_features(data, spans, hi - lo, multi)
            found |= {"n_multi_tokens": more["n_tokens"], "n_multi_byte_tokens": more["n_byte_tokens"], "window_entropy": more["window_entropy"]}
        for k in parts:
            parts[k].append(found[k])
    return {k: np.concatenate(v) for k, v in parts.items()}


_NAMES = (*FEATURES, *MORE)
_REAL = ("token_entropy", "window_entropy")
#: Columns of measures next to those of a table, whose own names may be the same.
_MARK = "__q_"


def _measured(docs: DataFrame, path: str, multi: str, names: list[str]) -> DataFrame:
    """Columns ``names`` of ``docs`` and after them the features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                f = features(batch.column("text"), fertility(path), fertility(multi))
                yield pa.RecordBatch.from_arrays([*map(batch.column, names), *(pa.array(f[k], pa.float64() if k in _REAL else pa.int64()) for k in _NAMES)], names=[*names, *(_MARK + k for k in _NAMES)])
        finally:
            fertility.cache_clear()
            B.release()

    schema = StructType([*(docs.schema[n] for n in names), *(StructField(_MARK + k, DoubleType() if k in _REAL else LongType()) for k in _NAMES)])
    return docs.mapInArrow(run, schema)


def _judged(docs: DataFrame, measured: DataFrame, bands: Mapping[str, Band] | None) -> DataFrame:
    """``measured`` with ``__out``, by the given bands or those fitted to it; without them it is written once, which costs less than tokenising twice."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    if bands is not None:
        return _outside(_MARK, band_table(docs.sparkSession, bands), measured, lang)
    measured = materialize(measured, "measures", compression="zstd")
    return _outside(_MARK, materialize(bands_of(measured, lang, _MARK), "bands"), measured, lang)


def score(docs: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, bands: Mapping[str, Band] | None = None) -> DataFrame:
    """One row per document: doc_id, the base columns, base_failed, kept, ``outside`` (the measures out of their band), then the features.

    Without ``bands`` they are fitted to ``docs``.  Null, empty and blank texts have no words,
    so base_failed is true.  A null language has the band of those without one; so does a
    table without ``lang``.  Repeated rows each get their row; other columns, whatever their
    names, are not read.  An empty table gives no rows.
    """
    columns = ["doc_id", *(["lang"] if "lang" in docs.columns else [])]
    measured = _measured(docs.select("text", *columns), f"{tokenizers}/{vocabulary}", f"{tokenizers}/{MULTI}", columns)
    judged = _judged(docs, measured, bands)
    some = lambda ks: [F.col(_MARK + k).alias(k) for k in ks]
    failed = _base_failed(_MARK)
    return judged.select("doc_id", *some(FEATURES[:5]), failed.alias("base_failed"), (~failed & (F.col("__out") == "")).alias("kept"), F.col("__out").alias("outside"), *some(_NAMES[5:]))


def keep(docs: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, bands: Mapping[str, Band] | None = None) -> DataFrame:
    """Rows of ``docs`` whose verdict is kept, all columns as they are.

    Without ``bands`` they are fitted to ``docs``.  Odd rows and tables as in ``score``.
    """
    measured = _measured(docs, f"{tokenizers}/{vocabulary}", f"{tokenizers}/{MULTI}", docs.columns)
    judged = _judged(docs, measured, bands)
    return judged.filter(~_base_failed(_MARK) & (F.col("__out") == "")).select(*docs.columns)
