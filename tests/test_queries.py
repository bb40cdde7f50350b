from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from embertrail import queries as runs
from embertrail.plans import queries as plans

QUERIES, ORACLE_SQL = runs.QUERIES | plans.QUERIES, runs.ORACLE_SQL | plans.ORACLE_SQL


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(None if v[i] is None else float(v[i]) if isinstance(v[i], (int, float)) and not isinstance(v[i], bool) else str(v[i]) for i in order) for v in values], key=lambda r: [(x is None, str(type(x)), x) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, con, small, name):
    df = QUERIES[name](spark, small)
    got = rows(df.columns, df.collect())
    if name not in ORACLE_SQL:
        assert df.columns
        return
    cur = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    want = rows(columns, cur.fetchall())
    assert sorted(df.columns) == sorted(columns) and len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6)) for x, y in zip(a, b)), (a, b)
