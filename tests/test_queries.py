"""Every query with SQL against DuckDB, row by row."""

from __future__ import annotations

import math

import duckdb
import pytest

from corvane import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, small, name):
    got = catalog.queries()[name](spark, small)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    cur = con.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(got.columns)
    order = sorted(cols)
    want = sorted(tuple(plain(dict(zip(cols, r))[c]) for c in order) for r in cur.fetchall())
    have = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert a == b or all(x == y or math.isclose(float(x), float(y), rel_tol=1e-9) for x, y in zip(a, b)), (a, b)
