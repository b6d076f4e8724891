"""Every query against its SQL on the smallest test data, and the plans that matter."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    result = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert difference(result, connection, ORACLES[name]) is None
    else:
        assert result.count() > 0


def _plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()


def test_short_lists_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in _plan(spark, "out_1_analysis")


def test_lookups_reach_the_scan(spark):
    plan = _plan(spark, "agg_3_incremental_metrics")
    assert "LessThan(l_shipdate" in plan
    assert "l_tax" not in plan and "l_comment" not in plan


# name ratios have no built-in function
RATIOS = ("joi_7_scored_names", "out_6_candidate_rows")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[:3] in ("agg", "win", "top", "out", "joi") and n not in RATIOS))
def test_stays_in_the_jvm_without_nested_loops(spark, name):
    plan = _plan(spark, name)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert node not in plan
