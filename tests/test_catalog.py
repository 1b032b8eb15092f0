"""Every query with an SQL counterpart against DuckDB on the smallest tables."""

import os
from glob import glob

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from plumbline.plans.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for p in glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(df, columns):
    def one(x):
        if not isinstance(x, str) and pd.isna(x):
            return "null"
        if isinstance(x, float):
            return f"{x:.0f}" if x.is_integer() else f"{x:.6f}"
        return str(x)

    return sorted(tuple(one(x) for x in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf, db, name):
    got, want = QUERIES[name](spark, sf).toPandas(), db.sql(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got, columns) == plain(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_recall(spark, sf):
    assert QUERIES["ann_recall"](spark, sf).first().recall >= 0.9


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
