"""Scale guards on the physical plans of every registered query: no pairing of
rows (cartesian / nested-loop joins), no gathering of a key's rows into one
collection, aggregates split into partial and final steps."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "collect_list", "collect_set")


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_plan_has_no_pairing_or_gathering(spark, name):
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in FORBIDDEN:
        assert word not in plan, f"{name}: {word} in plan"
    # max_by over strings cannot use the fixed-width hash buffer, so Spark plans a
    # sort-based aggregate; either kind must run a partial step before the shuffle.
    if ("HashAggregate" in plan or "SortAggregate" in plan) and "Exchange" in plan:
        assert "partial_" in plan, f"{name}: aggregate without a partial step"


@pytest.mark.parametrize("name", ["m09_latest_point", "m10_trailing_range", "m31_state_code"])
def test_newest_number_is_a_hash_aggregate(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("name", ["m12_instant_vector", "m27_latest_run"])
def test_rows_are_reduced_before_any_sort(spark, name):
    """The aggregate next to the scan is a hash aggregate with a partial step."""
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "Aggregate" in x]
    partial = [x for x in lines if "partial_max_by" in x and "HashAggregate" in x]
    assert partial, plan
