"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from weftgraph.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def near(a, b):
    return len(a) == len(b) and all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(map(tuple, df.select(*columns).collect()), key=str)
    if name in ORACLES:
        want = sorted(duck.sql(ORACLES[name]).select(*[f'"{c}"' for c in columns]).fetchall(), key=str)
        assert len(rows) == len(want)
        assert all(near(a, b) for a, b in zip(rows, want, strict=True))
