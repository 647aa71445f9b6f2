"""Who owns the tables that stages write."""

import os
import threading
import time

from sleuthframe.llm import durable

from ..conftest import SMALL


def there(paths):
    return [p for p in paths if os.path.exists(p.removeprefix("file://").removeprefix("file:"))]


def settle(spark):
    """Spark's own threads let go of a finished query a little later."""
    for _ in range(4):
        time.sleep(1)
        durable.free(spark)


def test_stages_chain_lazily(spark):
    """No stage deletes what a lazy input, or an older DataFrame, still reads."""
    import corpus_pipeline

    docs, held = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        held.append(docs)
    counts = [d.count() for d in held]
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0 and counts[4] > 0
    assert [d.count() for d in held] == counts


def test_two_pipelines_in_one_driver(spark):
    import corpus_pipeline

    out = {}

    def work(k):
        out[k] = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect())

    threads = [threading.Thread(target=work, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert out[0] == out[1] and out[0]


def test_run_leaves_only_its_result(spark):
    import corpus_pipeline

    settle(spark)
    before = set(durable.written())
    result = corpus_pipeline.run(spark, SMALL)
    settle(spark)
    left = set(durable.written()) - before
    assert left == {result.stored_at} and len(there(left)) == 1
    n, derived = result.count(), result.filter("mix_epoch = 1")
    del result
    settle(spark)
    # The derived DataFrame still reads the table.
    assert 0 < derived.count() <= n
    del derived
    settle(spark)
    assert not there(left)
