"""Registered queries against their SQL at the smallest scale, and the shape of plans."""

import re

import pytest
from parity import compare

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok, note


def test_entry_runs(spark):
    assert entry.entry(spark).columns


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("name", ["rsi_bounded", "volume_ratio", "price_moves"])
def test_indicators_share_one_shuffle(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert plan.count("Exchange hashpartitioning(symbol") == 1


@pytest.mark.parametrize("name", ["signals", "barrier_labels", "exit_monitor", "reconcile",
                                  "decision_cascade", "adx_sweep", "auc", "chrono_split"])
def test_no_products(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(entry.queries()["bars_15m"](spark, SF))
    assert "GreaterThan(value,0.0)" in plan
    schema = re.search(r"ReadSchema: (\S+)", plan).group(1)
    assert "event_id" not in schema and "user_id" not in schema


def test_rank_limit_runs_before_the_shuffle(spark):
    plan = plan_of(entry.queries()["universe_top10"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan
