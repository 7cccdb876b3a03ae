"""The flagship query: supplier price series, indicators, scores within the nation, top ten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.plans.base import BARS, MEMBERS, bars, members


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = S.drawdown(S.sma(S.daily_return(bars(spark, sf_dir)), 20))
    x = S.risk_adjusted_momentum(x, 60)
    last = x.groupBy("code").agg(F.max_by(F.struct("trade_date", "dd", "ram", (F.col("close") / F.col("ma20") - 1).alias("gap")), "trade_date").alias("l")).select("code", "l.*")
    z = S.zscore(last.join(members(spark, sf_dir), "code"), ["market"], "ram")
    top = z.withColumn("rank", F.row_number().over(Window.partitionBy("market").orderBy(F.desc_nulls_last("z"), "code"))).where("rank <= 10")
    return top.select("market", "code", "trade_date", *[F.round(c, 6).alias(c) for c in ("dd", "ram", "gap", "z")], "rank")


QUERIES = {"flagship": flagship}
ORACLES = {
    "flagship": f"""WITH {BARS}, {MEMBERS}, r AS (SELECT *, close / lag(close) OVER w - 1 AS ret, close / max(close) OVER w - 1 AS dd, avg(close) OVER (PARTITION BY code ORDER BY trade_date ROWS 19 PRECEDING) AS ma, row_number() OVER w AS n, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS k FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_date)),
 v AS (SELECT *, CASE WHEN count(ret) OVER f >= 60 AND stddev_samp(ret) OVER f > 0 THEN avg(ret) OVER f / stddev_samp(ret) OVER f END AS ram FROM r WINDOW f AS (PARTITION BY code ORDER BY trade_date ROWS 59 PRECEDING)),
 z AS (SELECT market, v.code, trade_date, dd, ram, CASE WHEN n >= 20 THEN close / ma - 1 END AS gap, CASE WHEN ram IS NULL THEN NULL WHEN count(ram) OVER m < 2 OR stddev_pop(ram) OVER m = 0 THEN 0 ELSE (ram - avg(ram) OVER m) / stddev_pop(ram) OVER m END AS z FROM v JOIN members USING (code) WHERE k = 1 WINDOW m AS (PARTITION BY market)),
 o AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY z DESC NULLS LAST, code) AS rank FROM z)
 SELECT market, code, trade_date, round(dd, 6) AS dd, round(ram, 6) AS ram, round(gap, 6) AS gap, round(z, 6) AS z, rank FROM o WHERE rank <= 10"""
}
