"""Every query with an oracle agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from folioscan.plans.catalog import ORACLES, QUERIES
from folioscan.sources.manuscripts import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as from read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "~" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [list(rel.columns).index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_every_query_runs_without_an_oracle(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, DATA).columns
