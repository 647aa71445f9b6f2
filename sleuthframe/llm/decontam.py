"""Benchmark decontamination with SimHash over item-sized windows.

Each document is slid over in windows of as many words as an item has; a document with
fewer words is one window.  Windows get a SimHash of ``BITS`` bits of their weighted word
shingles; a multi-index (the fingerprint cut into ``BLOCKS`` blocks of 12 bits) finds the
items of that size whose fingerprint agrees on a whole block, and the exact weighted Jaccard
similarity of the shingles decides.

By the pigeonhole principle every fingerprint within ``BLOCKS`` - 1 bits is found.  At
similarity 0.8 fingerprints differ in 15 % of the bits (the angle of vectors with cosine
0.889), which leaves a block whole with probability 0.14, so a pair at the very threshold is
missed only if all 64 blocks differ: about 7 in 100,000.  A random fingerprint agrees on a
block with 1.6 % of items, so the index leaves few to compare.

Windows that can't reach the threshold are left out beforehand without loss: an overlap of
o of m shingles gives at most o / (2m - o), so a window needs t*2m / (1 + t) positions whose
shingle stands in some item (t*(m + n) / (1 + t) if the window is a document of n shingles).

Scale: one pass over the texts, no shuffle of them.  Items are worked on in blocks of
``ITEM_BYTES`` of text: a block, whose size is therefore bounded, goes to every task; a
larger benchmark takes several passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
#: Blocks of a fingerprint, and bits of each.
BLOCKS, WIDTH = 64, 12
BITS = BLOCKS * WIDTH
#: Most bytes of item texts in one block.
ITEM_BYTES = 16 << 20


def _bits(hashes: np.ndarray) -> np.ndarray:
    """+1/-1 for each of the fingerprint's bits, by shingle."""
    words = np.stack([B.mix(hashes + np.uint64(k * B.BASE % 2**64)) for k in range(1, BITS // 64 + 1)], 1)
    return np.unpackbits(words.view(np.uint8).reshape(len(hashes), BITS // 8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def _votes(hashes: np.ndarray) -> np.ndarray:
    """Sums of the votes of a sequence of shingles of any length."""
    return sum((_bits(hashes[i : i + 8192]).sum(0, dtype=np.int32) for i in range(0, len(hashes), 8192)), np.zeros(BITS, np.int32))


def _window_votes(hashes: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """Sums of the votes of the windows [s, s + m): votes of a place are made once and summed over each window."""
    if m > 8192:
        return np.stack([_votes(hashes[s : s + m]) for s in starts.tolist()])
    places, back = np.unique(starts[:, None] + np.arange(m), return_inverse=True)
    back = back.reshape(len(starts), m)
    summed = np.zeros((len(places) + 1, BITS), np.int32)
    np.cumsum(_bits(hashes[places]), axis=0, out=summed[1:])
    # A window's places follow each other, so its votes are one difference.
    return summed[back[:, -1] + 1] - summed[back[:, 0]]


def simhash(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as the values of their blocks, from sums of weighted bit votes."""
    bits = (sums > 0).reshape(len(sums), BLOCKS, WIDTH)
    return bits @ (1 << np.arange(WIDTH, dtype=np.int32))


class MultiIndex:
    """Fingerprints by block: one sorted array of (block, value), so that all blocks of many windows are looked up at once."""

    def __init__(self, prints: np.ndarray):
        keys = (prints + self._offsets()).ravel()
        order = np.argsort(keys, kind="stable")
        self.size, self.keys, self.owners = len(prints), keys[order], order // BLOCKS

    @staticmethod
    def _offsets() -> np.ndarray:
        return np.arange(BLOCKS, dtype=np.int32) << WIDTH

    def near(self, prints: np.ndarray) -> np.ndarray:
        """Pairs (row of ``prints``, number of the indexed fingerprint) that agree on a block: all within BLOCKS - 1 bits, and most at twice that."""
        asked = (prints + self._offsets()).ravel()
        lo, hi = np.searchsorted(self.keys, asked, "left"), np.searchsorted(self.keys, asked, "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        row = np.repeat(np.arange(len(asked)) // BLOCKS, n)
        pair = np.unique(row * self.size + self.owners[at])
        return np.stack([pair // self.size, pair % self.size], 1)


class Items:
    """A block of benchmark items: shingles, and an index of fingerprints for each size in words."""

    def __init__(self, ids: list, texts: list[str | None], shingle: int = SHINGLE):
        self.shingle = shingle
        self.by_size: dict[int, tuple[list, list[np.ndarray], MultiIndex]] = {}
        grouped: dict[int, tuple[list, list[np.ndarray]]] = {}
        for item, text in zip(ids, texts, strict=True):
            size, hashes = self._shingles(text)
            if size:
                group = grouped.setdefault(size, ([], []))
                group[0].append(item)
                group[1].append(hashes)
        for size, (items, hashes) in grouped.items():
            prints = simhash(np.stack([_votes(h) for h in hashes]))
            self.by_size[size] = (items, [np.sort(h) for h in hashes], MultiIndex(prints))
        every = [h for _, hashes, _ in self.by_size.values() for h in hashes]
        self.known = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        # A bit for each value of 20 bits of a hash: most shingles are told apart by one look.
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def _shingles(self, text: str | None) -> tuple[int, np.ndarray]:
        data = np.frombuffer((text or "").encode(), np.uint8)
        starts, ends, _ = B.words(data, np.array([0, len(data)]))
        hashed = B.span_hash(B.prefix_hash(data, B.LOWER), starts, ends)
        n = len(hashed)
        return n, (B.grams(hashed, self.shingle) if n >= self.shingle else B.grams(hashed, n) if n else hashed)


def _similarity(a: np.ndarray, b: np.ndarray) -> Fraction:
    """Weighted Jaccard similarity of two sorted multisets of shingles."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(values)), np.bincount(at[len(a) :], minlength=len(values))
    return Fraction(int(np.minimum(x, y).sum()), int(np.maximum(x, y).sum()))


def hits(data: np.ndarray, off: np.ndarray, items: Items, threshold: Fraction = THRESHOLD) -> list[tuple[int, object, int, int, Fraction]]:
    """(text, item, first word, words, similarity) of the best window for each text and item that it contains."""
    starts, ends, first = B.words(data, off)
    hashed = B.span_hash(B.prefix_hash(data, B.LOWER), starts, ends)
    of = np.repeat(np.arange(len(off) - 1), np.diff(first))
    best: dict[tuple[int, object], tuple[Fraction, int, int]] = {}
    grams = {k: B.grams(hashed, k) for k in {min(s, items.shingle) for s in items.by_size}}
    seeds = {}
    for k, g in grams.items():
        at = np.flatnonzero(items.hint[(g >> np.uint64(44)).astype(np.int64)])
        at = at[np.isin(g[at], items.known)]
        seeds[k] = at[of[at] == of[at + k - 1]]
    need_share = 2 * threshold / (1 + threshold)
    n_words = np.diff(first)
    n_seeds = {k: np.bincount(of[at], minlength=len(off) - 1) for k, at in seeds.items()}
    for size, (ids, shingles, index) in items.by_size.items():
        k = min(size, items.shingle)
        m = size - k + 1
        need = -(-need_share.numerator * m // need_share.denominator)
        seed = seeds[k]
        # Texts with fewer words than the item are one window, with the same bound for unequal sizes.
        shorter = (n_words >= k) & (n_words < size)
        shorter &= n_seeds[k] * need_share.denominator * 2 >= need_share.numerator * (m + n_words - k + 1)
        for d in np.flatnonzero(shorter).tolist():
            inside = grams[k][first[d] : first[d] + n_words[d] - k + 1]
            for _, j in index.near(simhash(_votes(inside)[None])).tolist():
                sim = _similarity(np.sort(inside), shingles[j])
                if sim >= threshold:
                    key, found = (d, ids[j]), (sim, 0, int(n_words[d]))
                    if key not in best or found > best[key]:
                        best[key] = found
        if len(seed) < need:
            continue
        # Windows [s, s + m) of shingle positions with enough seeds: from runs of ``need`` seeds in a row.
        span = seed[need - 1 :] - seed[: len(seed) - need + 1]
        lo, hi = seed[need - 1 :][span < m] - m + 1, seed[: len(seed) - need + 1][span < m]
        if not len(lo):
            continue
        where = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]))
        where = where[(where >= 0) & (where + size <= len(hashed))]
        where = where[of[where] == of[where + size - 1]]
        for part in np.array_split(where, len(where) * min(m, 8192) // 20_000 + 1):
            if not len(part):
                continue
            for i, j in index.near(simhash(_window_votes(grams[k], part, m))).tolist():
                sim = _similarity(np.sort(grams[k][part[i] : part[i] + m]), shingles[j])
                if sim >= threshold:
                    at = int(part[i])
                    key, found = (int(of[at]), ids[j]), (sim, -(at - int(first[of[at]])), size)
                    if key not in best or found > best[key]:
                        best[key] = found
    return [(d, item, -at, size, sim) for (d, item), (sim, at, size) in sorted(best.items(), key=lambda x: (x[0][0], str(x[0][1])))]


def item_blocks(benchmark: DataFrame, limit: int = ITEM_BYTES) -> Iterator[Items]:
    """The benchmark as blocks of bounded size, fetched one at a time."""
    sized = benchmark.select("item_id", "text").filter("text is not null")
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // limit))
    if blocks == 1:
        rows = sized.collect()
        yield Items([r[0] for r in rows], [r[1] for r in rows])
        return
    slot = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        rows = sized.filter(slot == b).collect()
        yield Items([r[0] for r in rows], [r[1] for r in rows])


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): documents that hold an item, with the best window.

    Clean documents have no row.  Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; items of
    fewer than five words are one shingle; null, empty and blank items and texts match
    nothing.  A text with fewer words than an item is one window.  Items with equal texts are all reported; of windows with equal similarity the
    first counts.  Repeated documents each get their rows.  Only doc_id, text, item_id are read.
    """
    kind, item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    out = None
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            for batch in batches:
                found = [(lo + d, *rest) for lo, _, data, off in B.chunks(batch.column("text")) for d, *rest in hits(data, off, shared.value, threshold)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], to_arrow_type(item)), pa.array([float(f[4]) for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())],
                    names=["doc_id", "item_id", "similarity", "first_word", "n_words"],
                )

        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id {item.simpleString()}, similarity double, first_word long, n_words long")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no benchmark item."""
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for lo, _, data, off in B.chunks(batch.column("text")):
                    good[[lo + h[0] for h in hits(data, off, shared.value, threshold)]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
