"""Every query with SQL gives what DuckDB gives for it."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.7f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = [sorted(tuple(map(plain, r)) for r in f[names].itertuples(index=False)) for f in (got, want)]
    assert rows[0] == rows[1]


def test_entry(spark):
    assert entry.entry(spark).count() == 1
