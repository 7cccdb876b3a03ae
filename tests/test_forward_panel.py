DATA = "/root/testdata/sf0.001"


def test_forward_panel_equals_the_two_panels_joined(spark):
    from tidemark.plans.evidence import forward_panel, raw_panel
    from tidemark.plans.series import panel

    want = raw_panel(spark, DATA).join(panel(spark, DATA).select("code", "month", "fwd"), ["code", "month"], "left")
    got = forward_panel(spark, DATA)
    assert got.columns == want.columns and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_redundancy_takes_its_panel_from_one_written_table(spark):
    from tidemark.plans.registry import QUERIES

    plan = QUERIES["ev_redundancy"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan and "l_quantity" not in plan

