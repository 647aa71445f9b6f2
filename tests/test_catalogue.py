"""Every registered query of the engine gives the rows of its SQL in DuckDB."""

import duckdb
import pytest

from sleuthframe.plans import catalogue, readings  # noqa: F401  (registers the queries of the readers)

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    if name in catalogue.SQL:
        cursor = duck.execute(catalogue.SQL[name])
        names = [c[0] for c in cursor.description]
        at = [names.index(c) for c in columns]
        assert got == sorted(str(tuple(r[i] for i in at)) for r in cursor.fetchall())
    else:
        assert got


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
