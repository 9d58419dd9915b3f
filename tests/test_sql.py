"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from palimp.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        p = f"{SF}/{t}"
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def shown(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.5f}" if isinstance(v, float) else str(v)


def same_rows(spark, con, query, sql) -> None:
    got = query(spark, SF)
    want = con.sql(sql)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    a = sorted(tuple(shown(r[c]) for c in names) for r in got.collect())
    order = [want.columns.index(c) for c in names]
    assert a == sorted(tuple(shown(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql(spark, con, name):
    same_rows(spark, con, QUERIES[name], ORACLES[name])
