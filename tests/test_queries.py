"""All queries with SQL against DuckDB at the smallest size at which they are compared."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace import queries

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype).lower()
        if kind.startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif kind.startswith("float"):
            df[c] = df[c].astype(float).map("{:.9g}".format)
        else:
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    got, want = plain(queries.QUERIES[name](spark, DATA).toPandas()), plain(duck.execute(queries.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) and (got.values == want.values).all()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
