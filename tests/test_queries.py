"""Every query that has SQL gives the rows of its SQL on the smallest test tables."""

import glob
import os

import duckdb
import pytest

from loresift.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(columns).collect()), key=str)
    result = con.sql(catalogue.SQL[name])
    assert sorted(result.columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    want = sorted((tuple(norm(v) for v in r) for r in con.sql(f"SELECT {names} FROM ({catalogue.SQL[name]}) AS q").fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() >= 0


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["rank", "doc_id", "url", "title", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
