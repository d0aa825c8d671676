"""Every query of the core that has SQL, against that SQL, on the smallest tables."""

import glob
import os

import pytest

from marginalia.plans import catalog

DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    answer = db.execute(catalog.SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in answer.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs_without_sql(spark, name):
    df = catalog.QUERIES[name](spark, DIR)
    assert len(df.take(1)) == 1 and len(set(df.columns)) == len(df.columns)
