"""Every registered query with SQL against DuckDB over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lociframe.plans import catalogue as queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df, columns):
    def one(v):
        if pd.isna(v):
            return None
        if isinstance(v, (str, bool)):
            return v
        return round(float(v), 6)

    return sorted((tuple(one(v) for v in r) for r in df[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert rows(got, list(got.columns)) == rows(want, list(got.columns))


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
