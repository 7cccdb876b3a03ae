import datetime as dt
import random

from tidemark.operators import asof

DAY = dt.date(2024, 1, 1)


def test_nested_intervals_are_joined_in_one_pass(spark):
    """Rows of a key lie in several batches of one task; each row is shuffled once, not once per block of days."""
    rng = random.Random(5)
    day = lambda i: DAY + dt.timedelta(days=i)
    iv = {(k, day(a := rng.randrange(0, 400))): (None if rng.random() < 0.05 else day(a + rng.choice([-1, 0, 3, 60, 300]))) for k in (*"abc", None) for _ in range(150)}
    iv = [(k, s, e, i) for i, ((k, s), e) in enumerate(iv.items())] + [("a", None, None, -1), ("d", day(0), day(9), 900), ("d", day(0), day(9), 901), ("d", day(0), day(5), 999)]
    probes = [(i, k, day(i)) for k in (*"abcd", "z", None) for i in range(-2, 420, 3)] + [(1, "a", None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = asof.interval_join(spark.createDataFrame(probes, "i int, code string, at date"), spark.createDataFrame(iv, "code string, start date, end date, no int"), "code", "at", "start", "end")
        assert got.columns == ["i", "code", "at", "start", "end", "no"]
        rows = sorted(map(tuple, got.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for i, k, at in probes:
        hold = [(s, e is not None, e or at, no) for c, s, e, no in iv if k is not None and c == k and s and at and s <= at and (e is None or at <= e)]
        best = max(hold, default=None)
        want.append((i, k, at, *((best[0], best[2] if best[1] else None, best[3]) if best else (None, None, None))))
    assert rows == sorted(want, key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("RepartitionByExpression") == 1
