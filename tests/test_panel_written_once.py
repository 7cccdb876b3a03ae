def test_regression_panel_is_taken_from_one_written_table(spark):
    from tidemark.plans.registry import QUERIES

    plan = QUERIES["fac_neutralize_wls"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan and "l_quantity" not in plan
