"""Every query with an oracle gives the oracle's rows on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from taxaloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def same(spark_df, duck_df):
    a, b = spark_df.toPandas(), duck_df
    assert sorted(a.columns) == sorted(b.columns)
    for c in b.columns:  # whole numbers with nulls: the oracle keeps them whole, toPandas makes them floats
        if str(b[c].dtype) == "Int64":
            a[c] = a[c].astype("Int64")
    text = lambda x: sorted(tuple("null" if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in x[sorted(a.columns)].itertuples(index=False))
    assert text(a) == text(b)


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, sf, con, name):
    same(catalog.QUERIES[name](spark, sf), con.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
