"""Registered queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from loxis import catalogue

SF = "/root/testdata/sf0.001"
SLOW = {"tc_cyclic", "tc_nonlinear", "ql_recursion", "neg_over_recursion", "reach_from_root", "tc_linear", "ql_member_closure"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def norm(rows):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in SLOW and catalogue.QUERIES[n].sql])
def test_query(spark, duck, name):
    df = catalogue.run(spark, SF, name)
    cols = sorted(df.columns)
    want = duck.sql(catalogue.QUERIES[name].sql)
    assert sorted(want.columns) == cols
    place = [want.columns.index(c) for c in cols]
    assert norm(tuple(r[c] for c in cols) for r in df.collect()) == norm(tuple(r[i] for i in place) for r in want.fetchall())
