"""Substring dedup and n-gram Jaccard join against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from sleuthframe.llm import jaccard, suffixdedup

from ..conftest import SMALL


def repeated(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        runs = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        yield len(d), sum(gone), len(runs), hashlib.sha256(kept).hexdigest(), len(kept), any(gone), ",".join(f"{a}:{b}" for a, b in runs)


@pytest.mark.parametrize(("length", "bucket"), [(400, 128), (60, 2)])
def test_substrings(spark, length, bucket):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r for r in suffixdedup.remove_repeats(docs, length, min(64, length // 4), bucket).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for i, want in zip(texts, repeated(texts.values(), length), strict=True):
        assert tuple(rows[i][1:]) == want


def test_substrings_of_odd_rows(spark, odd, none):
    """Nulls, empty and very long texts, periodic ones, repeated rows, texts of a window less, one, and more."""
    extra = [(90, "ab" * 60), (91, "x" * 45), (92, "y" + "same text of more than five words here"), *((100 + n, chr(97 + n % 26) * n) for n in (19, 20, 21)), (130, "é" * 10), (131, "aé" + "é" * 9 + "b")]
    docs = odd.unionByName(spark.createDataFrame([(i, t, None) for i, t in extra], "doc_id long, text string, lang string"), allowMissingColumns=True)
    got = sorted(map(str, (tuple(r) for r in suffixdedup.remove_repeats(docs, 20, 5, 2).collect())))
    rows = docs.select("doc_id", "text").collect()
    assert got == sorted(str((r["doc_id"], *w)) for r, w in zip(rows, repeated([r["text"] for r in rows], 20), strict=True))
    assert suffixdedup.remove_repeats(none).count() == 0


def test_long_texts_at_production_parameters(spark):
    """A periodic text, one without repeats that shares a passage, and copies of all sizes about the window."""
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90_000))
    texts = ["0123456789" * 15_000, line, "x" + line[50_000:50_400] + "y", "x" + line[60_000:60_399] + "z", line[70_000:71_000] + line[70_000:71_000], None, "", *("e" * n for n in (399, 400, 400, 401)), "漢字" * 100, "漢字" * 90 + line[:399]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixdedup.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(repeated(texts, 400))


def test_nothing_is_removed_without_the_suffix_sort(spark, monkeypatch):
    """Only whole texts that stand twice go by another way."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").dropDuplicates(["text"])
    rows = [(b, None, 3, 40, True) for b in range(3)]
    assert [suffixdedup.repeated_windows([r[1]], [r[2]], [r[3]], [r[4]], 50) for r in rows] == [[[(-3, 0), (0, 37)]]] * 3
    assert suffixdedup.remove_repeats(docs).filter("changed").count() > 0
    monkeypatch.setattr(suffixdedup, "_sorted_buckets", lambda length: lambda batches: iter(()))
    assert suffixdedup.remove_repeats(docs).filter("changed").count() == 0


def linked(rows):
    sets, word = [], re.compile(r"[^\x20\x09-\x0D]+")
    fold = {c: c + 32 for c in range(65, 91)}
    for _, t in rows:
        w = word.findall((t or "").translate(fold))
        sets.append(set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set())
    lead = list(range(len(rows)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                lead[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in g if d is not None), default=None) for k, g in groups.items()}
    return sorted(str((d, len(sets[i]), least[find(i)])) for i, (d, _) in enumerate(rows))


def test_jaccard(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    near = " ".join(f"w{i}" for i in range(60))
    more = spark.createDataFrame([(1000 + i, near.replace(f"w{5 * i} ", f"z{i} ")) for i in range(12)] + [(2000 + i, near.replace("w1 ", f"q{i} ").replace("w30 ", f"r{i} ").replace("w50 ", f"s{i} ")) for i in range(6)], "doc_id long, text string")
    # Ids of the odd rows move out of the way; null stays null.
    docs = docs.unionByName(more).unionByName(odd.selectExpr("doc_id + 5000 as doc_id", "text"))
    got = sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in jaccard.join(docs).collect())
    assert got == linked([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert jaccard.join(none).count() == 0
    # Lists dealt over cells of parts lose no pair.
    cut = jaccard.join(docs.filter("doc_id >= 1000 and doc_id < 5000"), rows=3)
    few = docs.filter("doc_id >= 1000 and doc_id < 5000").collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in cut.collect()) == linked([(r["doc_id"], r["text"]) for r in few])


def test_deduplicate_keeps_one_of_a_group_and_all_columns(spark, odd):
    out = jaccard.deduplicate(odd.filter("doc_id is null or doc_id <> 5"))
    assert out.columns == odd.columns
    texts = Counter(r["text"] for r in out.collect())
    assert texts["same text of more than five words here"] == 1
    assert sum(n for t, n in texts.items() if t and t.lower() == "one two three") == 1
    assert texts[None] == 2 and texts[""] == 1 and texts["   \n\t "] == 1
