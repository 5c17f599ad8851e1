"""Every query that has SQL gives the rows that DuckDB gives on the same tables; the others run."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from orrery.queries import FLAGSHIP, ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(x):
    if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return "-"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.number)):
        return "%d" % x if float(x) == int(x) else "%.9g" % x
    return str(x)


def rows(f):
    return sorted(tuple(map(plain, r)) for r in f[sorted(f.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, db, sf_dir):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(name, spark, sf_dir):
    assert len(QUERIES[name](spark, sf_dir).toPandas()) > 0


def test_flagship(spark, sf_dir):
    assert FLAGSHIP in ORACLES
