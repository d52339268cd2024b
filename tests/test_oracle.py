"""Every registered query with an oracle equals its DuckDB SQL on sf0.001."""

import math
import sys

import duckdb
import pytest

import __spark_entry__ as E
from vellum.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
ORACLE = E.oracle_sql()


def _canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_canon(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    s = E.queries()[name](spark, SF).toPandas()
    o = con.sql(ORACLE[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    cols = sorted(s.columns)
    rs = sorted((tuple(_canon(x) for x in r) for r in s[cols].itertuples(index=False, name=None)), key=repr)
    ro = sorted((tuple(_canon(x) for x in r) for r in o[cols].itertuples(index=False, name=None)), key=repr)
    assert rs == ro


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(ORACLE) <= set(E.queries())
    assert sys.modules["__spark_entry__"] is E
