"""Every registered query against its SQL twin on the smallest tables, plus plan checks."""

from __future__ import annotations

import pytest
from check_queries import compare, connect

from boursecraft.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    problem, _rows = compare(QUERIES[name](spark, SF), ORACLES[name], duck)
    assert not problem


@pytest.mark.parametrize("name", ["rec_current_metrics", "rec_live_metrics", "ts_derived_metrics", "sc_score_universe", "cmp_sections", "agg_deals", "agg_failure_tally", "src_chart_bars"])
def test_plans_have_no_python_and_no_pairing_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in plan


@pytest.mark.parametrize("name", ["src_annual_roe", "src_header_ratios", "src_statements", "src_key_ratios", "src_overview"])
def test_a_document_is_parsed_once(spark, name):
    kept = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 30))
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.maxPlanStringLength", kept)
    assert plan.count("from_json(") == 1
