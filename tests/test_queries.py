"""Every driver query: equal to its SQL on the smallest data set, and a sound plan."""

import re

import pytest

import __spark_entry__ as driver
from checks.compare import connect, same

# the training-data queries have tests of their own
QUERIES = {k: v for k, v in driver.queries().items() if not re.match(r"op\d+_|pipeline$", k)}
ORACLE = {k: v for k, v in driver.oracle_sql().items() if k in QUERIES}
# fits without SQL; the laws they obey are compared by the queries of checks/laws.py
SLOW = {"scorecard_store", "tree_store", "auto_store", "boosted_oof", "imbalance", "shift_report",
        "learning_curve", "calibrated_stack", "subset_ablation", "scorecard_fit", "ridge_stack",
        "stack", "calibrate", "history_store", "extended_store", "score_batch"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf_dir, duck, name):
    assert same(QUERIES[name](spark, sf_dir), duck, ORACLE[name]) == ""


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == SLOW


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["inst_agg", "bureau_agg", "late_streak", "metric_suite",
                                  "woe_table", "target_encode", "neighbour_encode", "auto_agg",
                                  "top_factors", "fold_rank_avg", "secondary_rates"])
def test_plan_has_no_cross_join_or_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert word not in plan


def test_row_wise_queries_do_not_shuffle(spark, sf_dir):
    for name in ("ratios", "tenure", "row_stats", "top_factors"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = QUERIES["reject_profile"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "o_orderdate" not in scan.split("ReadSchema")[1]
