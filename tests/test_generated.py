"""With generated code, as in production: a query or two of each module gives the rows of its SQL. The other tests run interpreted."""

from __future__ import annotations

import pytest

from tests.test_catalog import duck  # noqa: F401
from tests.test_catalog import test_query as check
from threadmill import catalog

NAMES = ["agg02_cost", "agg02_cost_rolled", "chk07_pricing_gaps", "dml08_keepers", "flt04_any_tag", "ret01_search_all", "ret04_cells", "ret16_exchanges", "ret18_windows", "ret23_listing", "snk04_upkeep", "snk06_threads", "src01_records", "src08_split_lines", "srt04_best", "str09_session_list", "win08_fold"]


@pytest.mark.parametrize("name", NAMES)
def test_generated(spark, duck, name):  # noqa: F811
    before = {k: spark.conf.get(k) for k in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")}
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    spark.conf.set("spark.sql.codegen.factoryMode", "FALLBACK")
    try:
        check(spark, duck, name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_names_are_known():
    assert set(NAMES) <= set(catalog.queries())
