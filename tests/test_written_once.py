"""Inputs of joins with themselves are computed once."""

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["st_reconcile", "overlay_exec_limits"])
def test_both_sides_are_taken_from_one_written_table(spark, name):
    from tidemark.plans.registry import QUERIES

    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan and "l_quantity" not in plan
