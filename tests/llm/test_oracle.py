"""Queries with SQL against DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import pytest

from corvane.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, small).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].sort_values(cols[1] if "id" not in cols[0] else cols).reset_index(drop=True) for x in (got, want))
    key = [c for c in cols if c.endswith("_id")]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (a, b))
    for c in cols:
        assert (a[c] == b[c]).all() or a[c].astype(float).sub(b[c].astype(float)).abs().max() < 1e-6, c
