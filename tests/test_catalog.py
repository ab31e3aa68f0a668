"""Every query with an oracle gives the oracle's rows on the small tables."""

import os

import duckdb
import pytest

from lecterna import catalog


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = (df[c].round(4) + 0.0 if df[c].dtype.kind == "f" else df[c]).astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in os.listdir(data):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{data}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, data, duck, name):
    got = normal(catalog.QUERIES[name](spark, data).toPandas())
    want = normal(duck.sql(catalog.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        bad = got[c].str.removesuffix(".0") != want[c].str.removesuffix(".0")
        assert not bad.any(), (c, got[bad].head(3), want[bad].head(3))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() >= 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
