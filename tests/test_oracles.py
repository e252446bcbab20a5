"""Every registered KPI query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tidemark.plans.oracle import ORACLES
from tidemark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v if isinstance(v, (int, type(None))) else str(v)


def test_every_query_but_one_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"broker_partition_skew"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, tables, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    r = tables.execute(ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(dict(zip(names, x, strict=True))[c]) for c in cols) for x in r.fetchall()), key=str)
    assert got == want
