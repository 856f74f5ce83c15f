"""Every registered query of the library against its DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from bazaarlens.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NaT or x != x else str(x)[:10] if hasattr(x, "year") else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, want = normal(registry.QUERIES[name](spark, SF).toPandas()), normal(duck.execute(registry.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == object or want[c].dtype == object:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c
        else:
            pd.testing.assert_series_equal(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=2e-6, check_names=False)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
