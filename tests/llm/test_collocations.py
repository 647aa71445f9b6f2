"""Collocations against plain Python over all phrases."""

import os
import re
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sleuthframe.llm import collocations, queries

from ..conftest import SMALL

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, most=3, inside=50, best=2000):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in found.items():
        longer = max((b for (other, w), b in found.items() if other == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))), default=0)
        if longer and 100 * longer >= inside * a:
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]], total[lang]))
    return sorted((lang, i + 1, w.decode(), -a, left, right, n, -s) for lang, v in out.items() for i, (s, a, w, left, right, n) in enumerate(sorted(v)[:best]))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute([(r["text"], r["lang"]) for r in docs.collect()])
    assert len(want) > 50
    assert rows_of(queries.op12_collocations(spark, SMALL)) == want


def test_longer_phrases_and_ranks(spark):
    rows = [("new york city hall. New York city hall; the city\n new york is new", "en")] * 3 + [("a b c d e, a b c d\tA B c", None), ("é É a b", "fr"), ("a b c d e f g", "en")] * 4
    df = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, f int, phrase string")
    for most in (2, 3, 4):
        assert rows_of(collocations.mine(df, least=3, most=most, best=5)) == brute(rows, 3, most, best=5)


def test_odd_rows(spark, odd, none):
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    assert rows_of(collocations.mine(odd, least=2)) == brute(rows, 2)
    assert collocations.mine(none).count() == 0


def test_chunks_do_not_change_counts(monkeypatch):
    pieces = pa.array(["a b a b", "c", "b a b", "é b a"])
    m, lang = np.array([3, 2, 5, 1]), pa.array(["x", "x", "y", "x"])

    def summed():
        out = Counter()
        for _, b in collocations.weighted_ngrams(lang, pieces, m, 3):
            for r in b.to_pylist():
                out[r["lang"], r["k"], r["phrase"]] += r["f"]
        return out

    whole = summed()
    monkeypatch.setattr(collocations, "CHUNK", 4)
    assert summed() == whole and whole["x", 2, "a b"] == 6 and whole["x", 0, ""] == 17 and whole["y", 3, "b a b"] == 5


def test_equal_phrases_meet_in_one_bucket(monkeypatch):
    """Hashes don't depend on the chunk, the language's number or the words around."""
    batch = pa.RecordBatch.from_pydict({"lang": ["y", "x", "x", "y"], "piece": ["a b c", "q a b c", "z a b", "c c a b c"], "m": [1, 2, 3, 4]})
    monkeypatch.setattr(collocations, "CHUNK", 8)
    at = {}
    for b in collocations.packed_ngrams(iter([batch, batch.slice(2)]), 3, 16):
        for bucket, grams in zip(b.column("bucket").to_pylist(), collocations.unpacked([b]), strict=True):
            for r in grams.to_pylist():
                at.setdefault((r["lang"], r["phrase"]), set()).add(bucket)
    assert all(len(v) == 1 for v in at.values()) and len(set.union(*at.values())) > 4


def test_hashes_of_counted_phrases_are_those_of_pieces():
    for hashed, grams in collocations.weighted_ngrams(pa.array(["x", "y"]), pa.array(["é b a b", "a a"]), np.array([1, 1]), 3):
        assert collocations.phrase_hashes(grams).tolist() == hashed.tolist()


def test_the_filter_loses_nothing_and_may_be_missing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    asked = []
    make = collocations.sieve_of
    monkeypatch.setattr(collocations, "sieve_of", lambda *a: asked.append(make(*a)) or asked[-1])
    want = brute(rows, 4, 4)
    assert rows_of(collocations.mine(docs, least=4, most=4)) == want
    assert len(asked) == 2 and all(x.bits is not None and x.bits.any() for x in asked)
    monkeypatch.setattr(collocations, "BLOOM_MOST", 1)
    assert rows_of(collocations.mine(docs, least=4, most=4)) == want and asked[-1].bits is None


def test_a_bucket_larger_than_its_memory_spills(monkeypatch):
    """More distinct phrases than the memory limit holds; the folder is gone afterwards."""
    seen, make = [], tempfile.mkdtemp
    monkeypatch.setattr(tempfile, "mkdtemp", lambda **k: seen.append(make(**k)) or seen[-1])

    def batches():
        for r in range(2):
            for i in range(0, 1_500_000, 50_000):
                names = [f"phrase number {x} of a very long list of such phrases" for x in range(i, i + 50_000)]
                yield pa.RecordBatch.from_arrays([pa.array(["en"] * 50_000), pa.array([11] * 50_000, pa.int32()), pa.array(names), pa.array([4 + r + (x % 5 == 0) for x in range(i, i + 50_000)])], schema=collocations._GRAMS)

    got = sum(b.num_rows for b in collocations.bucket_counts(batches(), 11, memory="60MB"))
    assert got == 300_000 and seen and not any(map(os.path.exists, seen))


def test_scores_are_exact_beyond_64_bits(spark):
    """The decimals of the score, for counts whose products pass 64 bits."""
    a, left, right = 10**14 + 7, 10**15 - 11, 3 * 10**14 + 1
    df = spark.range(1).select(F.lit(a).alias("a"), F.lit(left).alias("l"), F.lit(right).alias("r"))
    assert collocations.scored(df).first()["score"] == 1_000_000 * a * a // (left * right)
