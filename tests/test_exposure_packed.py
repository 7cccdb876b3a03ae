"""Exposures through funds are summed where an account's positions lie."""

from tidemark.operators import portfolio


def test_pairs_of_account_and_stock_are_not_shuffled(spark):
    """Without broadcasts: sums equal a plain loop, and no exchange is made on the subject of an account."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = [(a, f, 1.0 + a + f) for a in range(4) for f in range(a + 1)]
        h = [(f, s, (s + 1) / 10) for f in range(5) for s in range(4) if (f + s) % 3]
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        positions, holdings = frame(p, "account long, fund long, value double"), frame(h, "fund long, item long, weight double")
        none = frame([], "fund long, industry string, weight double")
        got = portfolio.exposure_signals(positions, holdings, none)
        plan = got._jdf.queryExecution().executedPlan().toString()
        want = {}
        for a, f, v in p:
            for g, s, x in h:
                if f == g:
                    e = want.setdefault((a, str(s)), [0.0, 0])
                    e[0] += v / sum(w for b, _, w in p if b == a) * x
                    e[1] += 1
        rows = {(r.account, r.subject): (round(r.exposure, 9), r.funds) for r in got.where("kind = 'stock_exposure'").collect()}
        assert rows == {k: (round(e, 9), n) for k, (e, n) in want.items() if e >= 0.05}
        assert "Exchange" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(account" in x and "subject" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
