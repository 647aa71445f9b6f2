"""Mixing, token counts and the whole pipeline."""

import math
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sleuthframe.llm import decontam, mixing, quality, secrets, tokencount

from ..conftest import SMALL
from .test_dedup import linked
from .test_filters import contaminated

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes):
    """Targets by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, [s for s in names if sizes[s]]
    while open_:
        rest = Fraction(total - sum(out.values()), sum(weight[s] for s in open_))
        full = [s for s in open_ if rest * weight[s] > 3 * sizes[s]]
        if not full:
            out |= {s: rest * weight[s] for s in open_}
            break
        out |= {s: Fraction(3 * sizes[s]) for s in full}
        open_ = [s for s in open_ if s not in full]
    return {s: float(out.get(s, 0)) for s in names}


def check_mix(rows, texts):
    sizes, taken = {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert sorted(r["size"] for r in rows) == sorted(len(WORD.findall(t or "")) for t in texts)
    want = filled(sizes)
    for r in rows:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-12, abs_tol=1e-9)
    for s, t in want.items():
        assert taken[s] == math.floor(t + 1e-9)


def test_mix(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for df in (docs, odd.withColumn("position", F.lit(1)), docs.withColumn("source", F.lit(None).cast("string")), docs.withColumn("source", F.when(F.col("doc_id") < 3, "tiny").otherwise(F.col("source")))):
        rows = mixing.mix_plan(df).collect()
        check_mix(rows, [r["text"] for r in df.collect()])
        again = mixing.mix_plan(df.repartition(7)).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix_plan(none).count() == 0


def test_every_epoch_has_its_own_place(spark):
    """Brute force: the source's shuffled words as one line, repeated, cut at its target."""
    rows = mixing.mix_plan(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        target, size = own[0]["target"], own[0]["source_size"]
        line = sorted((p["position"], p["taken"], r["doc_id"]) for r in own for p in r["places"] or ())
        assert sum(t for _, t, _ in line) == math.floor(target + 1e-9)
        # In order of their places documents follow each other without gaps, epoch after epoch in the same order.
        first = [d for _, _, d in line][: len([r for r in own if r["size"]])]
        assert [d for _, _, d in line] == (first * 3)[: len(line)]
        assert target <= 3 * size
        for r in own:
            assert len(r["places"] or ()) == r["epochs"] and sum(p["taken"] for p in r["places"] or ()) == r["taken"]

@pytest.mark.parametrize("knots", [((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 2.0)), ((0.0, 2.0), (0.3, 0.0), (0.6, 0.0), (1.0, 1.0))])
def test_inverse_demand(spark, knots):
    area = sum((u[0] - t[0]) * (t[1] + u[1]) / 2 for t, u in zip(knots, knots[1:], strict=False))

    def demand(x):
        out = 0.0
        for (t, w), (u, v) in zip(knots, knots[1:], strict=False):
            if x > t:
                e = min(x, u) - t
                out += w * e + (v - w) / (u - t) * e * e / 2
        return out / area

    rows = spark.range(0, 100).select((F.col("id") / 100).alias("share")).withColumn("at", mixing.inverse_demand(mixing._segments(knots), F.col("share"))).collect()
    assert all(abs(demand(r["at"]) - r["share"]) < 1e-9 for r in rows)


def test_mixed_documents_are_in_order(spark, odd):
    mixed = mixing.mix_documents(odd)
    rows = mixed.withColumn("p", F.spark_partition_id()).collect()
    at = [r["mix_position"] for r in sorted(rows, key=lambda r: r["p"])]
    assert at == sorted(at) and mixed.columns[: len(odd.columns)] == odd.columns
    ids = Counter((r["doc_id"], r["text"]) for r in rows)
    assert all(r["mix_epoch"] <= 3 and 0 < r["mix_taken"] <= r["mix_size"] for r in rows) and max(ids.values()) > 1
    # The order inside a source hangs on the key, so which document is cut may differ, not how many words are taken.
    assert sum(r["mix_taken"] for r in rows) == mixing.mix_plan(odd).agg(F.sum("taken")).first()[0]


def viterbi(word, scores, fallback):
    text = tokencount.MARK + word
    best = [(0.0, 0, 0)]
    for end in range(1, len(text) + 1):
        n = len(text[end - 1].encode())
        s, t, b = best[end - 1]
        options = [(s + n * fallback, t - n, b - n)]
        for start in range(end):
            if text[start:end] in scores:
                s, t, b = best[start]
                options.append((s + scores[text[start:end]], t - 1, b))
        best.append(max(options))
    return -best[-1][1], -best[-1][2]


def test_token_counts(spark, odd, none):
    scores = tokencount.piece_scores(f"{tokencount.TOKENIZERS}/{tokencount.VOCABULARY}")
    fallback, known = min(scores.values()) - 10, {}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) < 1500")
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        want = []
        for r in rows:
            words = WORD.findall(r["text"] or "")
            counts = [known.setdefault(w, None) or known.__setitem__(w, viterbi(w, scores, fallback)) or known[w] for w in words]
            want.append((r["doc_id"], len(words), sum(c[0] for c in counts), sum(c[1] for c in counts)))
        assert sorted(str(tuple(r)) for r in tokencount.count(df).collect()) == sorted(map(str, want))
    assert tokencount.count(none).count() == 0


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    docs = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in quality.score(spark.read.parquet(f"{SMALL}/documents.parquet")).filter("kept").collect()}
    docs = [r for r in docs if r["doc_id"] in kept]
    label = {int(x[1:-1].split(", ")[0]): int(x[1:-1].split(", ")[2]) for x in linked([(r["doc_id"], r["text"]) for r in docs])}
    docs = [r for r in docs if label[r["doc_id"]] == r["doc_id"]]
    dirty = {d for d, _ in contaminated([(r["doc_id"], r["text"]) for r in docs], items)}
    docs = {r["doc_id"]: secrets.redacted(r["text"]) for r in docs if r["doc_id"] not in dirty}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    sizes: dict[str, int] = {}
    assert {r["doc_id"] for r in rows} <= set(docs) and dirty
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source").collect()}
    for d, t in docs.items():
        sizes[source[d]] = sizes.get(source[d], 0) + len(WORD.findall(t))
    want = filled(sizes)
    taken: dict[str, int] = {}
    for r in rows:
        assert r["text"] == docs[r["doc_id"]] and r["mix_size"] == len(WORD.findall(r["text"]))
        taken[r["source"]] = taken.get(r["source"], 0) + r["mix_taken"]
    assert taken == {s: math.floor(t + 1e-9) for s, t in want.items() if t >= 1}
    assert [r["mix_position"] for r in rows] == sorted(r["mix_position"] for r in rows)
    assert len(corpus_pipeline.STAGES) == 5 and decontam.THRESHOLD == Fraction(4, 5)


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, SMALL)
            assert out.columns[: len(docs.columns)] == docs.columns
            assert out.count() <= (3 if stage is corpus_pipeline.source_mix else 1) * docs.count()
