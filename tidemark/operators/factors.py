"""The raw factor panel and the readiness of its inputs: what was known of each name on a day, found in one pass over one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import cash_conversion
from tidemark.operators.asof import asof_join
from tidemark.operators.series import frame, full, over

#: Price factors, of each of which more is better.
PRICE = ["momentum_12_1", "momentum_6_1", "short_reversal", "residual_momentum", "trend", "volatility_60", "volatility_120", "max_drawdown_120"]
QUALITY = ["roe", "gross_margin", "net_margin", "ocf_to_profit", "cash_conversion_assets", "accruals", "debt_ratio", "earnings_stability", "margin_change", "loss_profitability"]
VALUE = ["ep", "bp", "market_cap", "valuation_percentile"]
#: Factors of industrial firms that say nothing of a bank's or an insurer's figures.
INDUSTRIAL = ["gross_margin", "net_margin", "ocf_to_profit", "cash_conversion_assets", "accruals", "margin_change", "debt_ratio"]


def price_factors(bars: DataFrame) -> DataFrame:
    """Of the last bar of each month (code, trade_date, close): moves over 252 and 126 bars without the last 21 and their difference, the last 21 bars' move
    with its sign turned, votes of price, MA20 and MA60, minus the sample deviation of 60 and 120 returns, and the worst fall from a peak within 120 bars.

    Rows without a price above zero are left out first. A factor is null before its window is full.
    """
    c = F.col("close")
    at = lambda n: F.lag("close", n).over(over())
    x = bars.where("close > 0").withColumn("ret", c / at(1) - 1)
    ma20, ma60 = F.avg("close").over(frame(20)), F.avg("close").over(frame(60))
    sign = lambda a, b: F.when(a >= b, 1.0).otherwise(-1.0)
    few = full(20, sign(c, ma20))
    x = x.select(
        "code", "trade_date", "close", (at(21) / at(252) - 1).alias("momentum_12_1"), (at(21) / at(126) - 1).alias("momentum_6_1"), (-(c / at(21) - 1)).alias("short_reversal"),
        F.coalesce(full(60, (sign(c, ma20) + sign(c, ma60) + sign(ma20, ma60)) / 3), few).alias("trend"),
        full(61, -F.stddev_samp("ret").over(frame(60))).alias("volatility_60"), full(121, -F.stddev_samp("ret").over(frame(120))).alias("volatility_120"),
        full(120, F.collect_list("close").over(frame(120))).alias("closes"), F.lead("trade_date").over(over()).alias("next"),
    )
    ends = x.where(F.col("next").isNull() | (F.trunc("next", "MM") > F.trunc("trade_date", "MM")))
    fall = F.aggregate(
        "closes", F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst")),
        lambda a, v: F.struct(F.greatest(a["peak"], v).alias("peak"), F.least(a["worst"], v / F.greatest(a["peak"], v) - 1).alias("worst")), lambda a: a["worst"],
    )
    return ends.withColumns({"residual_momentum": F.col("momentum_12_1") - F.col("momentum_6_1"), "max_drawdown_120": fall}).select("code", "trade_date", *PRICE)


def _present(names: list[str]) -> Column:
    return F.coalesce(*[F.col(n).cast("double") for n in names]).isNotNull()


def quality_snapshots(figures: DataFrame, floor: float = 1_000_000.0) -> DataFrame:
    """Figures (code, period, available_at, roe, gross_margin, net_margin, debt_ratio, net_income, cash, assets) with what follows from the ones before: minus the
    sample deviation of roe over eight periods (three at least), the change of the net margin since the last one there is within five, cash against
    profit, and whether the year was a loss. Rows with none of the fields are left out, so that they hide no earlier ones."""
    some = figures.where(_present(["roe", "gross_margin", "net_margin", "debt_ratio", "net_income", "cash", "assets"]))
    w = Window.partitionBy("code").orderBy("available_at", "period")
    eight, before = w.rowsBetween(-7, 0), w.rowsBetween(-4, -1)
    ratio = cash_conversion(F.col("net_income"), F.col("cash"), F.col("assets"), floor)
    x = some.withColumns({
        "earnings_stability": F.when(F.count("roe").over(eight) >= 3, -F.stddev_samp("roe").over(eight)),
        "margin_change": F.col("net_margin") - F.last("net_margin", ignorenulls=True).over(before),
        "ocf_to_profit": ratio["ratio"], "cash_conversion_assets": ratio["accrual"], "accruals": -ratio["accrual"],
        "loss_profitability": F.when(F.col("net_income") <= 0, -1.0).when(F.col("net_income") > 0, 0.0),
    })
    return x.select("code", "available_at", F.struct(*QUALITY).alias("quality"))


def value_snapshots(valuations: DataFrame, least: int = 24) -> DataFrame:
    """Valuations (code, available_at, ep, bp, market_cap), one a month, with the place of the mean of ep and bp among all of the code up to it, ties counting half."""
    v = F.coalesce((F.col("ep") + F.col("bp")) / 2, F.col("ep"), F.col("bp"))
    w = Window.partitionBy("code").orderBy("available_at").rowsBetween(Window.unboundedPreceding, 0)
    x = valuations.where(_present(["ep", "bp", "market_cap"])).withColumn("__v", v).withColumn("__h", F.collect_list("__v").over(w))
    place = F.aggregate("__h", F.lit(0.0), lambda a, h: a + F.when(h < F.col("__v"), 1.0).when(h == F.col("__v"), 0.5).otherwise(0.0)) / F.size("__h")
    x = x.withColumn("valuation_percentile", F.when(F.col("__v").isNotNull() & (F.size("__h") >= least), place))
    return x.select("code", "available_at", F.struct(*VALUE).alias("value"))


def factor_panel(bars: DataFrame, firms: DataFrame, figures: DataFrame, valuations: DataFrame) -> DataFrame:
    """All raw factors of each code (firms: code, finance) at the last bar of each month, from what was available on that day.

    The newest figures with any quality field and the newest valuation are taken apart from each other, as their days differ. Firms of finance keep
    roe and its stability and leave the industrial factors empty.
    """
    q = quality_snapshots(figures)
    v = value_snapshots(valuations)
    facts = q.unionByName(v, allowMissingColumns=True)
    x = asof_join(price_factors(bars), facts, "code", "trade_date", "available_at", ["quality", "value"], per_field=True)
    x = x.select("code", "trade_date", *PRICE, *[F.col(f"quality.{c}").alias(c) for c in QUALITY], *[F.col(f"value.{c}").alias(c) for c in VALUE])
    x = x.join(firms.select("code", "finance"), "code", "left")
    bank = F.coalesce("finance", F.lit(False))
    return x.withColumns({c: F.when(~bank, F.col(c)) for c in INDUSTRIAL} | {"financial_roe": F.when(bank, F.col("roe"))}).drop("finance")


def readiness(members: DataFrame, bars: DataFrame, firms: DataFrame, figures: DataFrame, valuations: DataFrame, least: float, days: int = 10) -> DataFrame:
    """Of each signal day: how many of its members (code, at) have ever traded, traded within ``days``, have an industry (firms: code, industry), figures and a
    valuation known by then, and one within ``days``; the share that has price, industry, figures and valuation, and whether it is below ``least``.

    A name that has not traded of late is known but not to be bought, so it counts as complete.
    """
    date = lambda df, day, name: df.select("code", F.col(day).alias("day"), F.col(day).alias(name))
    facts = date(bars.where("close > 0"), "trade_date", "traded")
    facts = facts.unionByName(date(figures.where(_present(["roe", "gross_margin", "cash", "debt_ratio"])), "available_at", "disclosed"), allowMissingColumns=True)
    facts = facts.unionByName(date(valuations.where(_present(["ep", "bp"])), "available_at", "valued"), allowMissingColumns=True)
    x = asof_join(members.select("code", "at"), facts, "code", "at", "day", ["traded", "disclosed", "valued"], per_field=True)
    x = x.join(firms.select("code", "industry"), "code", "left")
    known = F.coalesce("industry", F.lit("")) != ""
    fresh = lambda c: F.datediff("at", c) <= days
    complete = F.col("traded").isNotNull() & known & F.col("disclosed").isNotNull() & F.col("valued").isNotNull()
    g = x.groupBy("at").agg(
        F.count(F.lit(1)).alias("members"), F.count("traded").alias("prices"), F.count_if(fresh("traded")).alias("recent"), F.count_if(known).alias("industries"), F.count("disclosed").alias("financials"),
        F.count("valued").alias("valuations"), F.count_if(fresh("valued")).alias("fresh_valuations"), F.count_if(complete).alias("complete"),
    )
    return g.withColumn("ratio", F.col("complete") / F.col("members")).withColumn("rejected", F.col("ratio") + 1e-12 < least)
