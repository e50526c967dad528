"""Every query that has SQL gives the rows of its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from gradja.plans.registry import QUERIES, SQL

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(D):
        c.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{D}/{t}')")
    return c


def rows(df, cols):
    def cell(x):
        if hasattr(x, "__len__") and not isinstance(x, str):
            return str(list(x))
        if x is None or x != x:
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, (int, float)) or type(x).__name__.startswith(("int", "float", "Decimal")):
            return f"{float(x):.6g}"
        return str(x)

    return sorted(tuple(map(cell, r)) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    got, want = QUERIES[name](spark, D).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert rows(got, cols) == rows(want, cols)


def test_names():
    assert set(SQL) <= set(QUERIES)
