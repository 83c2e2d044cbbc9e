"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df):
    def one(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted([tuple(one(v) for v in r) for r in df.itertuples(index=False)], key=repr)


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_same_rows(spark, duck, name):
    got = entry.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(entry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
