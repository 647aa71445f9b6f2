"""Spelling variants against plain Python that compares all pairs of words."""

import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from sleuthframe.llm import queries, variants

from ..conftest import SMALL

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, shortest=6, least=5, times=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    form, count = {}, {}
    for w in n:
        others = [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], count[w], n.get(form[w], -1)) for w in n)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", F.coalesce("form", F.lit("")), "root", "n", "n_near", F.coalesce("form_n", F.lit(-1))).collect())


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = rows_of(queries.op13_spelling_variants(spark, SMALL))
    assert got == want and len(want) > 100


def test_forms_and_roots(spark):
    words = {"letter": 700, "letters": 130, "lettors": 20, "lettor": 20, "lettoor": 3, "aaaaaa": 9, "aaaaaaa": 50, "aaaaaaaa": 8, "bbbbbbé": 40, "bbbbbbe": 40, "bbbbbbb": 7, "lettxrs": 3, "ltters": 21}
    # Texts without an id: what the checksum takes from runs is the same in both.
    text = " ".join(w for w, n in words.items() for _ in range(n))
    for least, times in ((1, 5), (3, 2), (5, 5)):
        df = spark.createDataFrame([(None, text, "w")] * 2, "doc_id long, text string, word string")
        got = rows_of(variants.group(df, 5, least, times))
        assert got == brute([(None, text)] * 2, 5, least, times)
    chain = {r[0]: r[2] for r in got}
    assert chain["lettors"] == "letter"


def test_long_chains(spark):
    """Each word's form is the next one: ends are found over several doublings."""
    alphabet = "abcdefgh"
    vocabulary = [(alphabet[:i] + "z" * (8 - i), 3**i) for i in range(9)]
    df = spark.createDataFrame(vocabulary, "word string, n long")
    found = variants.forms(df, 3)
    roots = {r["word"]: r["root"] for r in variants.ends(found).collect()}
    assert roots == {w: "abcdefgh" for w, _ in vocabulary[:-1]}


def test_odd_rows(spark, odd, none):
    assert rows_of(variants.group(odd, 3, 2, 2)) == brute([(r["doc_id"], r["text"]) for r in odd.collect()], 3, 2, 2)
    assert variants.group(none).count() == 0


def test_no_pairs_are_made(spark):
    """A group of 24 words of one wildcard, and all their deletions: rows stay in proportion to the words."""
    df = spark.createDataFrame([("abcde" + c, 10 + i) for i, c in enumerate("fghijklmnopqrstuvwxyzéàü")], "word string, n long")
    assert variants._replaced(df).count() == 24
    got = {r["word"]: (r["n_near"], r["form"]) for r in variants.forms(df, 1).collect()}
    assert {v[0] for v in got.values()} == {23} and got["abcdef"][1] == "abcdeü" and got["abcdeü"][1] is None
