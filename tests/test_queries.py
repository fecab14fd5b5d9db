"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from leafworks.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.6f}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        got.collect()
        return
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted([plain(r[c]) for c in cols] for r in got.collect()) == sorted([plain(r[i]) for i in at] for r in want.fetchall())
