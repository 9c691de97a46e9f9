"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from lodestone.plans import registry

from .conftest import TINY


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(TINY):
        c.sql(f"create view {f.split('.')[0]} as select * from '{TINY}/{f}'")
    return c


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (bool, str)) or type(v).__name__ == "bool":
        return str(v)
    return repr(round(float(v), 6) + 0.0) if hasattr(v, "__float__") else str(v)


def table(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, TINY)
    if name in registry.SQL:
        assert table(got.toPandas()) == table(duck.sql(registry.SQL[name]).df())
    else:
        rows = got.collect()
        assert rows and len(set(got.columns)) == len(got.columns)
        assert all(any(r[c] is not None for r in rows) for c in got.columns)


def test_registry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
