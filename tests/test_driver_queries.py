"""Every driver query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from dissona.plans import driver

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if v is None or isinstance(v, bool) else str(v)
    return sorted([str([plain(r[i]) for i in order]) for r in values])


@pytest.mark.parametrize("name", sorted(driver.SQL))
def test_matches_sql(spark, duck, name):
    df = driver.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    want = duck.execute(driver.SQL[name])
    assert sorted(df.columns) == sorted(d[0] for d in want.description)
    assert got == rows([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(driver.QUERIES) - set(driver.SQL)))
def test_runs(spark, name):
    assert driver.QUERIES[name](spark, SF).count() > 0
