"""Full licence texts and notices in comments or without a year."""

from pathlib import Path

import duckdb
import pytest

from sleuthframe.llm import licenses

FOLDER = Path("/usr/share/common-licenses")


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["license_id"] for r in licenses.scan(docs, licenses.known(spark)).orderBy("doc_id").collect()]


def test_notices_and_titles(spark):
    body = licenses.LICENCES["MIT"].split("\n", 1)[1]
    bsd = licenses.LICENCES["BSD-3-Clause"]
    texts = [body, "# Copyright 2020 X\n" + body, " * Copyright (c) Someone\n" + body, "The MIT License (MIT)\n\nCopyright (c) Some One\n\n" + body, "Copyright Some One and others\nAll rights reserved.\n" + bsd, body.replace("The above", "#\n# Copyright notice apart, the above"), "# Copyright 2020 X\n"]
    assert found(spark, texts) == ["MIT", "MIT", "MIT", "MIT", "BSD-3-Clause", None, None]


@pytest.mark.skipif(not FOLDER.exists(), reason="no licence texts on this machine")
def test_full_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    texts = [(FOLDER / f).read_text() for f in names]
    apache = texts[0].replace("[yyyy] [name of copyright owner]", "2021 Someone")
    assert found(spark, [*texts, *(t.replace("\n", "\n * ") for t in texts), apache]) == [*names.values(), *names.values(), "Apache-2.0"]


def test_sql_equals_the_scan_on_variants(spark, tmp_path):
    """Titles, notices of all kinds, comment signs, line ends, cut and long texts: whole rows as DuckDB computes them."""
    body = licenses.LICENCES["MIT"].split("\n", 1)[1]
    heads = ["", "Copyright (c) 2020 X\n", "Copyright Someone\n", "// Copyright by Some One\n", "© Someone\n", "(C) X\n", "Copyright License terms\n", "Copyright by Law of 1999\n", " * All rights reserved.\n", "copyright someone\n", "COPYRIGHT 1999\r\n"]
    texts = [h + t for h in heads for t in (body, licenses.LICENCES["ISC"], "Copyright Notice: " + body, body[:-1], body.replace("\n", "\r\n"), "")] + [None, "é © ü", "word " * 20_000, "Copyright"]
    if FOLDER.exists():
        texts += [f.read_text() for f in sorted(FOLDER.iterdir()) if f.is_file()]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    cursor = con.execute(licenses.scan_sql())
    names = [c[0] for c in cursor.description]
    want = sorted(str(tuple(r[names.index(c)] for c in ("doc_id", "digest", "license_id"))) for r in cursor.fetchall())
    got = licenses.scan(spark.read.parquet(f"{tmp_path}/documents"), licenses.known(spark)).collect()
    assert sorted(str((r["doc_id"], r["digest"], r["license_id"])) for r in got) == want
    assert {r["license_id"] for r in got} >= {None, "MIT", "ISC"}
