"""Token-ID files against the library text by text; their encodings, pages and selective reads."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sleuthframe.llm import bytesops as B
from sleuthframe.llm import queries, tokenfiles

from ..conftest import SMALL

PATH = f"{tokenfiles.TOKENIZERS}/{tokenfiles.VOCABULARY}"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_never_change_the_ids(library):
    rng = random.Random(3)
    parts = [" ", " ", " ", "  ", "\n", "\n", "\t", "a", "Bc", "é", "×", "÷", "漢", "'s", "'", "1", "23", "!", "?.", ",", "\u0085", " ", "　", " ", "᠎", "​", "«", "🎉", "\x1c", "\x00", "<|endoftext|>", "ñ", "̀", "x" * 60]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    encoder = tokenfiles.Encoder(PATH)
    for lo, hi, data, off in B.chunks(pa.array(texts), 1 << 13):
        ids, n = encoder.chunk(data, off, 2)
        at = np.concatenate(([0], np.cumsum(n)))
        for i in range(lo, hi):
            assert ids[at[i - lo] : at[i - lo + 1]].tolist() == library(texts[i]), texts[i]


def test_memory_of_pieces_is_bounded(library, monkeypatch):
    monkeypatch.setattr(tokenfiles, "CACHED", 50)
    encoder = tokenfiles.Encoder(PATH)
    for k in range(40):
        texts = [f"word{k} other{i}" for i in range(30)]
        data, off = B.text_buffers(pa.array(texts))
        assert encoder.chunk(data, off, 2)[0].tolist() == [x for t in texts for x in library(t)]
    assert len(encoder.known) < 200 and len(encoder.older) < 200


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_query_equals_the_library(spark, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_token_files(spark, SMALL).collect()}
    at = 0
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect():
        ids = library(r["text"])
        assert got.pop(r["doc_id"]) == (at, len(ids), crc(ids))
        at += len(ids)
    assert not got


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files(spark, tmp_path, library, encoding):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    path = str(tmp_path / "t")
    tokenfiles.write(docs, path, keep=["lang", "source"], encoding=encoding, row_group=1 << 15, page=1 << 12)
    files = sorted((tmp_path / "t" / "tokens").glob("*.parquet"))
    groups = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        column = next(meta.row_group(0).column(i) for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema.startswith("ids"))
        assert ("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in column.encodings
        assert column.has_offset_index and column.has_column_index
    assert groups > len(files)
    assert "ids" not in tokenfiles.read(spark, path).select("doc_id", "lang", "start")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    rows = docs.orderBy("doc_id").collect()
    some = tokenfiles.read_documents(spark, path, rows[20]["doc_id"], rows[29]["doc_id"]).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["ids"], r["lang"], r["source"]) for r in some] == [(r["doc_id"], library(r["text"]), r["lang"], r["source"]) for r in rows[20:30]]
    corpus = [x for r in rows for x in library(r["text"])]
    for a, b in ((0, 1), (5, 700), (len(corpus) // 3, len(corpus) // 2), (len(corpus) - 9, len(corpus) + 50), (len(corpus) + 1, len(corpus) + 2)):
        got = tokenfiles.read_span(spark, path, a, b).orderBy("start").collect()
        assert [x for r in got for x in r["ids"]] == corpus[a:b]


def test_odd_rows(spark, odd, none, tmp_path, library):
    tokenfiles.write(odd, str(tmp_path / "o"), keep=["kept", "token"])
    got = tokenfiles.read(spark, str(tmp_path / "o")).collect()
    rows = odd.collect()
    assert sorted((str(r["doc_id"]), r["ids"], str(r["kept"]), str(r["token"])) for r in got) == sorted((str(r["doc_id"]), library(r["text"]), str(r["kept"]), str(r["token"])) for r in rows)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted([r["doc_id"] for r in rows], key=lambda i: (i is not None, i))
    ends = [r["start"] + r["n_tokens"] for r in ordered]
    assert [r["start"] for r in ordered] == [0, *ends[:-1]]
    tokenfiles.write(none, str(tmp_path / "n"))
    assert tokenfiles.checksums(spark, str(tmp_path / "n")).count() == 0
    assert tokenfiles.read_span(spark, str(tmp_path / "n"), 0, 5).count() == 0


def test_a_busy_id_is_many_parts(spark, tmp_path):
    docs = spark.range(0, 4000, 1, 4).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    path = str(tmp_path / "b")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokenfiles.write(docs, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["n_docs"] for r in tokenfiles.parts(spark, path).collect()]
    assert len(sizes) > 1 and max(sizes) < 3000


def test_unknown_encoding(spark, odd, tmp_path):
    with pytest.raises(ValueError):
        tokenfiles.write(odd, str(tmp_path / "x"), encoding="plain")
