"""The queries with SQL give the rows of their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tests.test_catalog import SF, TABLES, cell
from threadmill.llm import catalog


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame, found = catalog.queries()[name](spark, SF), db.sql(catalog.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(found.columns)
    rows, want = [r.asDict() for r in frame.collect()], [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    key = lambda rs: sorted(tuple(cell(r[c]) for c in columns) for r in rs)
    assert key(rows) == key(want)
