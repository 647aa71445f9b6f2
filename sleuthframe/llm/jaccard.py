"""Exact n-gram Jaccard join with set-relation skipping.

Documents with the same shingle set form one *class* and are joined once.  Classes are
indexed by the prefix of their sets in a global order (rare shingles first): two sets with
similarity of at least t share a shingle among their first n - ceil(t*n) + 1.  Work is then
skipped by relations between sets:

* index lists are sorted by set size and cut into blocks; whole blocks are skipped when
  sizes or the positions of the shared shingle rule out the needed overlap;
* neighbours in the lists are joined first, and their answers serve the rest: two sets that
  already hang together need no comparison; of the pairs between two components the likeliest
  is compared first, which settles most others; and what is left is first decided from the
  answers of the sets that they are highly similar to (``_derived``).  If a has the verified
  neighbour x and b has y, |a & b| lies between |x & y| less what a and b lack of them and
  |x & y| plus what they have beyond them, so one comparison of x and y answers for all pairs
  of their neighbours whose bounds settle it.  Only pairs that are still open are compared.
  What is asked for is who reaches whom, so no link between different texts is lost;
* pairs that are left meet a bound from parity signatures (the symmetric difference is at
  least the number of differing bits; a bit or more for each shingle, and a fold of them to
  512 bits inside the lists) before sets are compared exactly.

The order needs counts of shingles over all documents.  They are kept in a sketch of
``SLOTS`` counters, counted exactly and sent on a log scale of 8 bits: four megabytes whatever
the corpus, so it may be broadcast.  The order decides only how long lists get, never the
result.  Shingles that the sketch shows to be heavy are dealt over lists of their own before
the shuffle, so that a very common one is no task.

Scale: shuffled are the prefixes (about a fifth of the shingles, 40 bytes each), the
signatures of classes in shared lists, and the texts of documents that are left as possible
partners, found with a Bloom filter sized by their number and then an exact join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .components import components
from .durable import Scratch, free

SHINGLE = 5
THRESHOLD = (80, 100)
#: Counters of the shingle sketch; a bound on what is broadcast, not on shingles.
SLOTS = 1 << 22
_SHIFT = np.uint64(64 - 22)
_SKETCH_BLOCK = 4096
#: Bits of a Bloom filter for each key, and the most bits of one (32 MB); more keys than that serves go without.
BLOOM_BITS, BLOOM_MOST = 16, 1 << 28
_SIGNATURE_WORDS = 8
_BLOCK = 256
#: Most rows of one list that a task holds at once; longer lists are cut, their pairs dealt over cells of parts.
LIST_ROWS = 100_000
_SEEN = 500_000


def _need(na, nb, threshold=THRESHOLD):
    """Smallest intersection of sets of these sizes that makes a link."""
    t, of = threshold
    return -(-(t * (na + nb)) // (of + t))


def _sketch(rows: DataFrame) -> np.ndarray:
    """Log-scale counts of distinct shingles per distinct set over all documents, by slot, from the tasks' counts (block, counts)."""

    def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros(_SKETCH_BLOCK, np.int64), None
        for batch in group:
            at = batch.column("block")[:1]
            for x in batch.column("counts").to_pylist():
                total += np.frombuffer(x, f"u{len(x) // _SKETCH_BLOCK}")
        if at is not None:
            yield pa.RecordBatch.from_arrays([at, pa.array([np.minimum(8 * np.log2(total + 1.0), 255).astype(np.uint8).tobytes()], pa.binary())], names=["block", "counts"])

    sketch = np.zeros((SLOTS // _SKETCH_BLOCK, _SKETCH_BLOCK), np.uint8)
    for r in rows.groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        sketch[r["block"]] = np.frombuffer(r["counts"], np.uint8)
    return sketch.ravel()


def _parts(sketch: np.ndarray, rows: int) -> np.ndarray:
    """Parts that the list of a shingle is dealt over, by slot: 0 unless the slot has ``rows`` more than the usual one."""
    # By the sketch's 256 values: arrays of eight bytes a slot would be most of a task's memory.
    counts = 2.0 ** (np.arange(256) / 8.0) - 1.0
    upto = np.cumsum(np.bincount(sketch, minlength=256))
    middle = counts[np.searchsorted(upto, [(len(sketch) - 1) // 2, len(sketch) // 2], "right")].mean()
    above = counts - middle
    return np.where(above > rows, np.minimum(np.ceil(2 * above / rows), 60_000), 0).astype(np.uint16)[sketch]


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signature(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles by hash slot, in words: a power of two of at least a bit a shingle, 512 at least."""
    bits = 64 * _SIGNATURE_WORDS
    while bits < len(s):
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _fold(signature: np.ndarray, words: int = _SIGNATURE_WORDS) -> np.ndarray:
    """The signature at fewer slots: slots that fall together add their parities."""
    return np.bitwise_xor.reduce(signature.reshape(-1, words), axis=0)


def _scan(docs: DataFrame, shingle: int) -> DataFrame:
    """One pass over the texts: (doc_id, text_key, key, n, signature, s0..s7) of each document, and (block, counts) of each task's shingles.

    A document's row holds its set's digest, size, parity signature and the fold of that, and
    a null block.  Sets that a task has met are counted once.
    """
    names = ["doc_id", "text_key", "key", "n", "signature", *(f"s{i}" for i in range(_SIGNATURE_WORDS)), "block", "counts"]
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, id_type = np.zeros(SLOTS, np.uint32), set(), None
        for batch in batches:
            keys, sizes, signs = [], [], []
            for _, _, data, off in B.chunks(batch.column("text")):
                new = []
                for s in B.shingle_sets(data, off, shingle):
                    keys.append(_key(s))
                    sizes.append(len(s))
                    signs.append(_signature(s))
                    if keys[-1] not in seen:
                        seen.add(keys[-1])
                        new.append(s)
                if new:
                    np.add.at(total, (np.concatenate(new) >> _SHIFT).astype(np.int64), 1)
                if len(seen) > _SEEN:
                    seen.clear()
            words = np.array([_fold(x) for x in signs], np.uint64).reshape(-1, _SIGNATURE_WORDS).view(np.int64)
            id_type = batch.column("doc_id").type
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array([x.tobytes() for x in signs], pa.binary()), *(pa.array(words[:, i]) for i in range(_SIGNATURE_WORDS)), pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        blocks = total.reshape(-1, _SKETCH_BLOCK)
        most = blocks.max(1)
        for some in np.array_split(np.flatnonzero(most), max(1, np.count_nonzero(most) // 256)):
            if len(some):
                rows = [blocks[i].astype("u1" if most[i] < 1 << 8 else "u2" if most[i] < 1 << 16 else "u4").tobytes() for i in some.tolist()]
                n, empty = len(rows), [pa.nulls(len(rows), t) for t in (id_type, pa.binary(), pa.binary(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*empty, *[pa.nulls(n, pa.int64())] * _SIGNATURE_WORDS, pa.array(some, pa.int32()), pa.array(rows, pa.binary())], names=names)

    return docs.select("doc_id", "text", _text_key().alias("text_key")).mapInArrow(B.tidy(run), f"doc_id {kind.simpleString()}, text_key binary, key binary, n long, signature binary, " + ", ".join(f"s{i} long" for i in range(_SIGNATURE_WORDS)) + ", block int, counts binary")


def _text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


_LIST = "token long, key binary, np long, part int, crossed boolean"


def _prefixes(docs: DataFrame, sketch: np.ndarray, shingle: int, threshold: tuple[int, int], rows: int) -> DataFrame:
    """(token, key, np, part, crossed): the prefix of each set, once per set and task; np is size * 2**32 + position.

    The list of a heavy shingle is dealt by digest into parts, and each two parts (and each by
    itself) are a list of their own, in which ``part`` tells them apart.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch.tobytes())
    t, of = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = np.frombuffer(shared.value, np.uint8), set()
        parts_of = _parts(order, rows)
        for batch in batches:
            for _, _, data, off in B.chunks(batch.column(0)):
                tokens, keys, places, part, crossed = [], [], [], [], []
                for s in B.shingle_sets(data, off, shingle):
                    n = len(s)
                    if not n or (key := _key(s)) in seen:
                        continue
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(key)
                    p = n - -(-t * n // of) + 1
                    slot = (s >> _SHIFT).astype(np.int64)
                    first = np.argsort(order[slot], kind="stable")[:p]
                    place, own = (n << 32) + np.arange(p), s[first]
                    heavy = parts_of[slot[first]]
                    mine, cross = np.zeros(p, np.int32), np.zeros(p, bool)
                    if heavy.any():
                        at = np.repeat(np.arange(p), np.maximum(heavy, 1))
                        other = np.arange(len(at)) - np.searchsorted(at, at)
                        mine = np.where(heavy > 0, int.from_bytes(key[:8], "little") % np.maximum(heavy, 1).astype(np.uint64), 0).astype(np.int64)[at]
                        cross = mine != other
                        cell = B.mix(own[at] + B.U(B.BASE) * (np.minimum(mine, other) * 65_536 + np.maximum(mine, other) + 1).astype(np.uint64))
                        own, place, mine = np.where(heavy[at] > 0, cell, own[at]), place[at], mine.astype(np.int32)
                    tokens.append(own)
                    places.append(place)
                    part.append(mine)
                    crossed.append(cross)
                    keys += [key] * len(own)
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(keys, pa.binary()), pa.array(np.concatenate(places)), pa.array(np.concatenate(part)), pa.array(np.concatenate(crossed))], names=["token", "key", "np", "part", "crossed"])

    return docs.select("text").mapInArrow(B.tidy(run), _LIST)


def _groups(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """Batches sorted by ``token``, cut between lists; with ``most`` also inside a list of more rows, whose last row is then repeated."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        token = table.column("token").to_numpy()
        cut = int(np.searchsorted(token, token[-1], "left"))
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        if most is not None and rest.num_rows > most:
            yield rest
            rest = rest.slice(rest.num_rows - 1)
    if rest is not None:
        yield rest


def _shared(threshold: tuple[int, int]):
    """Rows of lists that hold two sets or more, repeated rows once, each with its ``others``.

    Others are the set's neighbours in the list in three orders (size, and two by digest) that
    sizes and positions allow to link: a few a set, however long the list.  Long lists pass in parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, LIST_ROWS):
            token, place = table.column("token").to_numpy(), table.column("np").to_numpy()
            key = pc.fill_null(table.column("key"), b"").to_pylist()
            same = np.zeros(len(token), bool)
            for i in (np.flatnonzero((token[1:] == token[:-1]) & (place[1:] == place[:-1])) + 1).tolist():
                same[i] = key[i] == key[i - 1]
            at = np.flatnonzero(~same)
            token = token[at]
            twin = np.zeros(len(at), bool)
            twin[1:] |= token[1:] == token[:-1]
            twin[:-1] |= token[1:] == token[:-1]
            at, token = at[twin], token[twin]
            key, size, left = [key[i] for i in at.tolist()], place[at] >> 32, (place[at] >> 32) - (place[at] & 0xFFFFFFFF)
            others: list[list[bytes] | None] = [None] * len(at)
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]])) if len(at) else np.zeros(1, np.int64)
            # Neighbours by size of all lists at once, then by digest in lists of three sets and more.
            pairs = [(np.flatnonzero(token[1:] == token[:-1]),) * 2]
            pairs[0] = (pairs[0][0], pairs[0][1] + 1)
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if hi - lo > 2:
                    for cut in (0, 8):
                        order = np.array(sorted(range(lo, hi), key=lambda i: key[i][cut:]))
                        pairs.append((order[:-1], order[1:]))
            x, y = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
            ok = np.minimum(left[x], left[y]) >= _need(size[x], size[y], threshold)
            for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                if others[i] is None:
                    others[i] = []
                others[i].append(key[j])
            where = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(key, pa.binary()), pa.array(place[at]), *(table.column(c).take(where).combine_chunks() for c in ("part", "crossed")), pa.array(others, pa.list_(pa.binary()))], names=["token", "key", "np", "part", "crossed", "others"])

    return run


def _pairs(threshold: tuple[int, int]):
    """Pairs (a, b) of sets in a list that hang together by no answer so far and whose size, positions and signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[bytes, bytes]] = set()
        for table in _groups(batches):
            token, place = table.column("token").to_numpy(), table.column("np").to_numpy()
            size, pos = place >> 32, place & 0xFFFFFFFF
            root = np.unique(np.array(table.column("root").to_pylist(), dtype=object), return_inverse=True)[1]
            sign = np.stack([table.column(f"s{i}").to_numpy() for i in range(_SIGNATURE_WORDS)], 1).view(np.uint64)
            key, part, cross = table.column("key").to_pylist(), table.column("part").to_numpy(), table.column("crossed").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
            fresh = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if hi - lo < 2 or (root[lo:hi] == root[lo]).all():
                    continue
                for i in range(lo, hi, _BLOCK):
                    a = np.arange(i, min(i + _BLOCK, hi))
                    for j in range(i, hi, _BLOCK):
                        b = np.arange(j, min(j + _BLOCK, hi))
                        # Whole blocks go by size (lists are sorted by it) and by the positions of the list's shingle.
                        if size[b[0]] * threshold[0] > size[a[-1]] * threshold[1]:
                            break
                        most = 1 + min(int((size[a] - pos[a]).max()), int((size[b] - pos[b]).max())) - 1
                        if most < _need(int(size[a[0]]), int(size[b[0]]), threshold):
                            continue
                        ok = (root[a][:, None] != root[b][None, :]) & (b[None, :] > a[:, None])
                        if cross[lo]:
                            ok &= part[a][:, None] != part[b][None, :]
                        x, y = np.nonzero(ok)
                        x, y = a[x], b[y]
                        need = _need(size[x], size[y], threshold)
                        left = np.minimum(size[x] - pos[x], size[y] - pos[y]) >= need
                        x, y, need = x[left], y[left], need[left]
                        differ = np.bitwise_count(sign[x] ^ sign[y]).sum(1).astype(np.int64)
                        left = (size[x] + size[y] - differ) // 2 >= need
                        fresh += zip(x[left].tolist(), y[left].tolist(), strict=True)
            new = {(min(key[x], key[y]), max(key[x], key[y])) for x, y in fresh} - seen
            if len(seen) > _SEEN:
                seen.clear()
            seen |= new
            new = list(new)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.binary()), pa.array([p[1] for p in new], pa.binary())], names=["a", "b"])

    return run


def _cells(lists: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """Lists of bounded length, as (token, key, np, part, crossed).

    What the sketch did not show: a list of more than ``most`` rows is dealt by digest into
    parts of half that, and each two parts (and each by itself) are a list of their own, so
    that no pair is lost and no task holds the whole list.
    """
    long = lists.groupBy("token").agg(F.count("*").alias("rows")).filter(F.col("rows") > most)
    if long.isEmpty():
        return lists
    long = scratch.write(long, "long-lists")
    parts = long.select("token", F.ceil(F.col("rows") * 2 / most).cast("int").alias("parts"))
    dealt = lists.drop("part", "crossed").join(parts, "token").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = dealt.withColumn("other", other).select(F.xxhash64("token", F.least("part", "other"), F.greatest("part", "other")).alias("token"), "key", "np", "part", (F.col("part") != F.col("other")).alias("crossed"))
    return lists.join(long.select("token"), "token", "left_anti").unionByName(cells)


def _bloom_hits(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text_key, text) of documents whose text may be wanted, equal texts of a task once: by a Bloom filter sized by the keys, a bounded one."""
    keys = max(wanted.count(), 1)
    bits = 1 << max(20, (BLOOM_BITS * keys - 1).bit_length())
    block = 1 << 16

    def slots(keys: list[bytes]) -> np.ndarray:
        raw = np.frombuffer(b"".join(keys), np.uint32).reshape(-1, 4)
        return raw.astype(np.int64) % bits

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = slots(batch.column(0).to_pylist()).ravel()
            np.bitwise_or.at(mine, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for i in range(0, len(mine), block):
            if (part := mine[i : i + block]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i >> 16], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "bits"])

    def union(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros(block, np.uint8), None
        for batch in group:
            at = batch.column("block")[:1]
            for x in batch.column("bits").to_pylist():
                total |= np.frombuffer(x, np.uint8)
        if at is not None:
            yield pa.RecordBatch.from_arrays([at, pa.array([total.tobytes()], pa.binary())], names=["block", "bits"])

    shared = None
    if bits <= BLOOM_MOST:
        filled = np.zeros((bits >> 19, block), np.uint8)
        for r in wanted.mapInArrow(fill, "block int, bits binary").groupBy("block").applyInArrow(union, "block int, bits binary").collect():
            filled[r["block"]] = np.frombuffer(r["bits"], np.uint8)
        shared = docs.sparkSession.sparkContext.broadcast(filled.tobytes())

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, seen = None if shared is None else np.frombuffer(shared.value, np.uint8), set()
        for batch in batches:
            keys = batch.column("text_key").to_pylist()
            if not keys:
                continue
            good = np.ones(len(keys), bool)
            if have is not None:
                at = slots(keys)
                good = ((have[at >> 3] >> (at & 7)) & 1).all(1)
            for i in np.flatnonzero(good).tolist():
                good[i] = keys[i] not in seen
                seen.add(keys[i])
            if len(seen) > _SEEN:
                seen.clear()
            yield batch.filter(pa.array(good))

    return docs.select(_text_key().alias("text_key"), "text").mapInArrow(B.tidy(test), "text_key binary, text string")


def _sets(docs: DataFrame, keys: DataFrame, classes: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """(key, shingles) of the classes in ``keys``."""
    wanted = scratch.write(keys.distinct().join(classes.select("key", "text_key"), "key"), "wanted")
    texts = _bloom_hits(docs, wanted.select("text_key")).join(wanted, "text_key").dropDuplicates(["key"]).select("key", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [s.tobytes() for _, _, data, off in B.chunks(batch.column("text")) for s in B.shingle_sets(data, off, shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], names=["key", "shingles"])

    return scratch.write(texts.mapInArrow(B.tidy(sets), "key binary, shingles binary"), "sets")


def _compared(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b and other columns) with na, nb and ``common``: the sizes of the sets and of what they share."""
    columns = [c for c in pairs.columns if c not in ("na", "nb")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                out.append((len(p), len(q), int((both[1:] == both[:-1]).sum())))
            sizes = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(z, pa.int64()) for z in sizes)], names=[*columns, "na", "nb", "common"])

    left = known.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    right = known.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in columns)
    return pairs.select(columns).join(left, "a").join(right, "b").mapInArrow(B.tidy(compare), f"{kinds}, na long, nb long, common long")


def _links(common: Column, threshold: tuple[int, int]) -> Column:
    t, of = threshold
    return of * common >= t * (F.col("na") + F.col("nb") - common)


def _leaders(answers: DataFrame) -> DataFrame:
    """(x, y, lack, own): each set with verified links and its smallest linked neighbour, less ``lack`` shingles of that and with ``own`` beyond it."""
    both = answers.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("na").alias("nx"), F.col("nb").alias("ny"), "common")
    both = both.union(answers.select("b", "a", "nb", "na", "common"))
    return both.filter("y < x").groupBy("x").agg(F.min_by(F.struct("y", (F.col("ny") - F.col("common")).alias("lack"), (F.col("nx") - F.col("common")).alias("own")), "y").alias("l")).select("x", "l.*")


def _derived(known: DataFrame, led: DataFrame, threshold: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Links among pairs with leaders (``_led``): from the answers of these where they settle it, else by comparison.

    Each two leaders are compared once, and bound all pairs that they lead.
    """
    asked = led.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    told = scratch.write(_compared(known, asked).select(F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("common").alias("told")), "told")
    bounded = led.join(told, (F.least("la", "lb") == F.col("ta")) & (F.greatest("la", "lb") == F.col("tb")))
    least, most = F.col("told") - F.col("lacka") - F.col("lackb"), F.col("told") + F.col("owna") + F.col("ownb")
    bounded = scratch.write(bounded.select("a", "b", "ia", "ib", "na", "nb", _links(least, threshold).alias("yes"), _links(F.least(most, "na", "nb"), threshold).alias("maybe")), "bounded")
    rest = _compared(known, bounded.filter("maybe and not yes").select("a", "b", "ia", "ib")).filter(_links(F.col("common"), threshold))
    return bounded.filter("yes").select("ia", "ib").union(rest.select("ia", "ib"))


def _led(pairs: DataFrame, leaders: DataFrame) -> DataFrame:
    """``pairs`` with the leaders (la, lb) of their sets, what these lack of them and own beyond them; a set without links leads itself."""
    side = lambda c: leaders.select(F.col("x").alias(c), F.col("y").alias(f"l{c}"), F.col("lack").alias(f"lack{c}"), F.col("own").alias(f"own{c}"))
    zero = F.lit(0).cast("long")
    led = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return led.select(*pairs.columns, *[F.coalesce(f"l{c}", c).alias(f"l{c}") for c in "ab"], *[F.coalesce(f"{k}{c}", zero).alias(f"{k}{c}") for k in ("lack", "own") for c in "ab"])


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` whose sets are in different components, with the roots (ra, rb) of these."""
    for c in "ab":
        own = roots.select(F.col("node").alias(f"__{c}"), F.col("root").alias(f"r{c}"))
        pairs = pairs.drop(f"r{c}").join(own, F.col(f"i{c}") == F.col(f"__{c}"), "left").drop(f"__{c}").withColumn(f"r{c}", F.coalesce(f"r{c}", f"i{c}"))
    return pairs.filter("ra <> rb")


def _possible(pairs: DataFrame, classes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs whose sizes and whole signatures allow a link, with nodes (ia, ib), sizes (na, nb), and the shingles by which it may be more than enough (slack)."""
    names = ["a", "b", "ia", "ib", "na", "nb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slack = []
            for na, nb, x, y in zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                words = min(len(p), len(q))
                differ = int(np.bitwise_count(_fold(p, words) ^ _fold(q, words)).sum())
                slack.append((na + nb - differ) // 2 - _need(na, nb, threshold))
            slack = pa.array(slack, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), slack], names=[*names, "slack"]).filter(pc.greater_equal(slack, 0))

    left = classes.select(F.col("key").alias("a"), F.col("node").alias("ia"), F.col("n").alias("na"), F.col("signature").alias("x"))
    right = classes.select(F.col("key").alias("b"), F.col("node").alias("ib"), F.col("n").alias("nb"), F.col("signature").alias("y"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a binary, b binary, ia binary, ib binary, na long, nb long, slack long")


_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def _node(kind: str) -> Column:
    """A class as a node: bytes that sort by its smallest doc_id, null last, and end with its key; so a component's smallest node tells its smallest doc_id."""
    if kind in _INTEGRAL:
        own = F.unhex(F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    else:
        own = F.concat(F.encode(F.col("doc_id").cast("string"), "UTF-8"), F.unhex(F.lit("00")))
    return F.concat(F.coalesce(F.concat(F.unhex(F.lit("00")), own), F.unhex(F.lit("01"))), F.col("key"))


def _doc_id(node: Column, kind: str) -> Column:
    """The doc_id of a node."""
    own = F.substring(node, F.lit(2), F.length(node) - (17 if kind in _INTEGRAL else 18))
    value = F.conv(F.hex(own), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63))) if kind in _INTEGRAL else F.decode(own, "UTF-8")
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", value).cast(kind)


def join(docs: DataFrame, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, rows: int = LIST_ROWS) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id, component.

    Two documents link when ``threshold[1]`` * |intersection| >= ``threshold[0]`` * |union| of
    their sets of distinct ``shingle``-word shingles (A-Z lower-cased); ``component_id`` is the
    smallest doc_id that is reachable by links (of a type that is neither integral nor string:
    the smallest as text).  Texts with fewer words are one shingle;
    null, empty and blank texts have an empty set and link with nothing: component_id is
    their own doc_id.  Repeated rows and equal texts link (similarity 1).  A null doc_id
    takes part but is never the smallest; a component of nothing else has a null id.
    component_id is reported only: components may share one, where ids are null or repeated.
    ``component``, the digest of the set with that id, tells them apart; it is null for
    empty sets.
    Columns other than doc_id and text are not read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    folds = [f"s{i}" for i in range(_SIGNATURE_WORDS)]
    scanned = scratch.write(_scan(docs, shingle), "nodes")
    nodes = scanned.filter("block is null").drop("block", "counts")
    classes = nodes.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"), *[F.first(c).alias(c) for c in ("n", "signature", *folds)])
    classes = scratch.write(classes.withColumn("node", _node(kind)), "classes")
    prefixes = _prefixes(docs, _sketch(scanned.filter("block is not null").select("block", "counts")), shingle, threshold, rows)
    lists = scratch.write(prefixes.repartition("token").sortWithinPartitions("token", "np", "key").mapInArrow(B.tidy(_shared(threshold)), f"{_LIST}, others array<binary>"), "lists")
    del prefixes
    free(spark)

    # Neighbours in the lists come first: answers from which the rest are derived.
    near = lists.filter("others is not null").select("key", F.explode("others").alias("other")).filter("key <> other")
    near = near.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()
    near = scratch.write(_possible(near, classes, threshold), "near")
    free(spark)
    known = _sets(docs, near.select(F.col("a").alias("key")).union(near.select("b")), classes, shingle, scratch)
    first = scratch.write(_compared(known, near).filter(_links(F.col("common"), threshold)), "links")
    roots = components(first.select(F.col("ia").alias("a"), F.col("ib").alias("b")))

    sides = classes.join(roots.withColumnsRenamed({"node": "__n"}), F.col("node") == F.col("__n"), "left").select("key", F.coalesce("root", "node").alias("root"), *folds)
    rest = _cells(lists.drop("others"), rows, scratch).join(sides, "key").repartition("token").sortWithinPartitions("token", "np", "key")
    pairs = rest.mapInArrow(B.tidy(_pairs(threshold)), "a binary, b binary").distinct()
    pairs = scratch.write(_possible(pairs, classes, threshold), "pairs")
    free(spark)
    leaders = scratch.write(_leaders(first), "leaders")
    led = scratch.write(_led(_rooted(pairs, roots), leaders), "led")
    known = _sets(docs, led.select(F.explode(F.array("a", "b", "la", "lb")).alias("key")), classes, shingle, scratch)
    # The likeliest pair between two components, then the rest of those that are still apart.
    best = led.groupBy(F.least("ra", "rb"), F.greatest("ra", "rb")).agg(F.max_by(F.struct("a", "b", "ia", "ib"), F.struct("slack", "a", "b")).alias("p")).select("p.*")
    second = scratch.write(_compared(known, best).filter(_links(F.col("common"), threshold)).select("ia", "ib"), "links")
    final = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second))
    rest = scratch.write(_rooted(led, final), "led")
    if not rest.isEmpty():
        third = scratch.write(_derived(known, rest, threshold, scratch), "links")
        final = components(final.select(F.col("node").alias("a"), F.col("root").alias("b")).union(third))

    root = F.coalesce("root", "node")
    labels = classes.select("key", "node").join(final.withColumnsRenamed({"node": "__n"}), F.col("node") == F.col("__n"), "left")
    # A table of its own: a join of two plain shuffles is one whose hot keys (copies) Spark can split.
    labels = scratch.write(labels.select(F.col("key").alias("__key"), F.substring(root, -16, 16).alias("__root"), _doc_id(root, kind).alias("__c")), "labels")
    scratch.keep(scanned, labels)
    return nodes.join(labels, nodes["key"] == F.col("__key"), "left").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("__c")).alias("component_id"), F.col("__root").alias("component"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, all columns, of which one of each near-duplicate group stays: that of the smallest doc_id.

    Of rows with that doc_id the one with the smallest text digest stays, once.  Documents
    without words are no duplicates of anything and all stay.
    """
    labels = join(docs, **options)
    best = labels.filter("n_shingles > 0").groupBy("component").agg(F.min_by(F.struct("doc_id", "text_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("k")).select("k.*")
    best = best.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t"))
    keyed = docs.withColumn("__key", _text_key())
    match = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__t"))
    blank = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*\z")
    one = keyed.filter(~blank).join(best, match).withColumn("__n", F.row_number().over(Window.partitionBy("__key", "__d").orderBy(F.lit(1)))).filter("__n = 1")
    return one.select(*docs.columns).unionByName(docs.filter(blank))
