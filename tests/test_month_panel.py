import random

from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.operators.monthly import VALUES, month_panel


def windows(bars):
    x = S.daily_return(bars)
    x = x.withColumns({"mom": F.col("close") / F.lag("close", 120).over(S.over()) - 1, "rev": -(F.col("close") / F.lag("close", 5).over(S.over()) - 1), "vol": F.stddev_samp("ret").over(S.frame(60)), "dd": F.col("close") / F.max("close").over(S.frame(120)) - 1})
    x = S.risk_adjusted_momentum(x).join(S.trend_strength(bars).withColumnRenamed("strength", "trend"), ["code", "trade_date"])
    return x.groupBy("code", F.trunc("trade_date", "MM").alias("month")).agg(F.max_by(F.struct(*VALUES), "trade_date").alias("x")).select("code", "month", "x.*")


def test_month_ends_equal_windows_over_all_rows(spark):
    rng = random.Random(4)
    rows = [(c, i, 100.0 if c == "flat" else None if c == "gaps" and i % 9 == 4 else rng.uniform(5, 9)) for c, n in (("a", 400), ("b", 61), ("c", 1), ("d", 130), ("flat", 200), ("gaps", 300), (None, 90)) for i in range(n) if rng.random() < 0.9]
    bars = spark.createDataFrame(rows, "code string, i int, close double").select("code", F.expr("date_add(date'2020-01-05', i)").alias("trade_date"), "close")
    spark.conf.set("spark.sql.ansi.enabled", "false")  # A row without any vote has the trend null.
    try:
        want = sorted(map(str, windows(bars.where("code is not null")).collect()))
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "150", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = month_panel(bars)
            assert sorted(map(str, got.where("code is not null").collect())) == want
            assert got.where("code is null").count() == 4
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_no_rows(spark):
    assert month_panel(spark.createDataFrame([], "code long, trade_date date, close double")).count() == 0


def test_panel_walks_no_frame_at_every_row(spark):
    from tidemark.plans.evidence import raw_panel

    plan = raw_panel(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Window" not in plan
