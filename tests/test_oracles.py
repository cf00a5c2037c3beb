"""Every registered query against its DuckDB statement on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, norm

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
# Queries without SQL only have to give rows here; what they must give is tested beside their operators.
ROWS_ONLY = sorted(set(entry.queries()) - set(ORACLES))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([norm(r[c]) for c in cols] for r in (x.asDict(False) for x in df.collect()))
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    want = sorted([norm(r[i]) for i in order] for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
