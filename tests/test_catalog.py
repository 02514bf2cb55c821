"""Every query with SQL gives the rows of its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from threadmill import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries without rows on the smallest tables; they have some on the next larger ones.
MAY_BE_EMPTY: set[str] = set()


def cell(v):
    if v is None or v != v:
        return "NULL"
    return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="session")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    rows = [r.asDict() for r in frame.collect()]
    assert rows or name in MAY_BE_EMPTY
    if name not in catalog.oracle_sql():
        return
    found = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(found.columns)
    want = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    key = lambda rs: sorted([tuple(cell(r[c]) for c in columns) for r in rs])
    assert key(rows) == key(want)
