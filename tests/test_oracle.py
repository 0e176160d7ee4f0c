"""Differential test: every query with an oracle SQL against DuckDB on the same tables (sf0.001)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from flowlens.sources.tables import TABLES

ORACLE = E.oracle_sql()


def _norm(v):
    if hasattr(v, "tolist") and not isinstance(v, (int, float, str)):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    pdf = df.toPandas()
    res = con.execute(ORACLE[key])
    cols = [d[0] for d in res.description]
    rows = res.fetchall()
    assert sorted(pdf.columns) == sorted(cols)
    sc = sorted(cols)
    got = sorted((tuple(_norm(r[c]) for c in sc) for r in pdf.to_dict("records")), key=repr)
    idx = [cols.index(c) for c in sc]
    exp = sorted((tuple(_norm(r[i]) for i in idx) for r in rows), key=repr)
    assert got == exp
