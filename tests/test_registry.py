"""Every query with SQL gives what DuckDB gives on the same tables."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

from vecatlas.plans import registry


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda x: "" if pd.isna(x) else repr(float(x)) if isinstance(x, numbers.Real) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert len(got)
    sql = registry.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
