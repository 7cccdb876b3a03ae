"""Cross-section models and factor evidence over panels (month, code, ...): every date is a group of its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import quantile_rank, rank_avg
from tidemark.sources.lake import written


#: Cody's rational approximations of the error function (numerator, denominator), for |x| up to 0.46875, up to 4, and beyond.
ERF_SMALL = ((1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
ERFC_LARGE = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)
#: Acklam's rational approximation of the normal quantile (relative error below 1.15e-9), for the middle and the tails.
PPF_MIDDLE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
PPF_TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
PPF_LOW = 0.02425


def _ratio(pair: tuple[tuple[float, ...], tuple[float, ...]], x: Column) -> Column:
    """Two polynomials by Horner's rule, highest power first."""
    top, bottom = (reduce(lambda out, t: out * x + F.lit(t), terms[1:], F.lit(terms[0])) for terms in pair)
    return top / bottom


def normal_cdf(z: Column) -> Column:
    """Normal distribution function by the error function (error below 1e-15)."""

    def upper(x: Column) -> Column:
        y = x * x
        large = F.exp(-y) / x * (F.lit(0.56418958354775628695) - _ratio(ERFC_LARGE, 1 / y) / y)
        return F.when(x <= 0.46875, 1 - x * _ratio(ERF_SMALL, y)).when(x <= 4, F.exp(-y) * _ratio(ERFC_MIDDLE, x)).otherwise(large) / 2

    half = F.transform(F.array(F.abs(z.cast("double")) / 2**0.5), upper)[0]
    return F.when(z > 0, 1 - half).otherwise(half)


def normal_ppf(p: Column) -> Column:
    """Inverse normal distribution function (relative error below 1.15e-9); at 0 and 1 it is -8 and 8."""

    def value(p: Column) -> Column:
        r, low, high = (p - 0.5) * (p - 0.5), F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
        inside = F.when(p < PPF_LOW, _ratio(PPF_TAIL, low)).when(p <= 1 - PPF_LOW, (p - 0.5) * _ratio(PPF_MIDDLE, r)).otherwise(-_ratio(PPF_TAIL, high))
        return F.when(p <= 0, -8.0).when(p >= 1, 8.0).otherwise(inside)

    return F.transform(F.array(p.cast("double")), value)[0]


def leave_one_out(rets: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """Mean return of the others of a day (and group): (total - own) / (count - 1)."""
    w = Window.partitionBy(*by)
    n = F.count("ret").over(w)
    return rets.withColumn("proxy", F.when((n >= least) & F.col("ret").isNotNull(), (F.sum("ret").over(w) - F.col("ret")) / (n - 1)))


def last_rows(df: DataFrame, n: int, key: str = "code", date: str = "trade_date") -> DataFrame:
    """The last n rows of each key with k = 0 for the last one."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(date))) - 1
    return df.withColumn("k", k).where(F.col("k") < n)


def beta(df: DataFrame, window: int = 252, least: int = 60) -> DataFrame:
    """CAPM of the last ``window`` common days: alpha, beta, R2."""
    x = last_rows(df.where("ret is not null and proxy is not null"), window)
    g = x.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.regr_intercept("ret", "proxy").alias("alpha"), F.regr_slope("ret", "proxy").alias("beta"), F.regr_r2("ret", "proxy").alias("r2"))
    return g.where(F.col("n") >= least)


def two_factor(df: DataFrame, window: int = 252, least: int = 60) -> DataFrame:
    """Market and industry betas by cross-product sums in closed form."""
    x = last_rows(df.where("ret is not null and proxy is not null and group_proxy is not null"), window)
    g = x.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("ret", "proxy").alias("ym"), F.covar_pop("ret", "group_proxy").alias("yi"), F.var_pop("proxy").alias("mm"), F.var_pop("group_proxy").alias("ii"), F.covar_pop("proxy", "group_proxy").alias("mi"))
    det = F.nullif(F.col("mm") * F.col("ii") - F.col("mi") * F.col("mi"), F.lit(0.0))
    return g.where(F.col("n") >= least).select("code", ((F.col("ym") * F.col("ii") - F.col("yi") * F.col("mi")) / det).alias("beta_market"), ((F.col("yi") * F.col("mm") - F.col("ym") * F.col("mi")) / det).alias("beta_industry"))


def residuals(df: DataFrame, window: int = 252, least: int = 60) -> DataFrame:
    b = beta(df, window, least)
    x = last_rows(df.where("ret is not null and proxy is not null"), window).join(b.select("code", "alpha", "beta"), "code")
    return x.withColumn("e", F.col("ret") - F.col("alpha") - F.col("beta") * F.col("proxy"))


def residual_momentum(res: DataFrame, skip: int = 21, vol_window: int = 120) -> DataFrame:
    """Log of the compounded residuals before the last ``skip`` days, and their deviation in the last ``vol_window``."""
    return res.groupBy("code").agg(
        F.sum(F.when(F.col("k") >= skip, F.log(F.greatest(1 + F.col("e"), F.lit(1e-6))))).alias("residual_momentum"),
        F.stddev_samp(F.when(F.col("k") < vol_window, F.col("e"))).alias("residual_vol"),
    )


def neutralize_wls(df: DataFrame, value: str, industry: str, numeric: list[str], cap: str, least: int = 30, small: int = 3) -> DataFrame:
    """code, month, residual of a weighted regression on industry dummies (small or missing ones pooled) and numeric exposures (filled by the month's median, beside
    a dummy for what was missing), per month. Names without a value are left out; months of fewer than ``least`` have nulls.

    Weights are square roots of caps, clipped to their 1 % and 99 % quantiles. Dummies take each industry's weighted mean out of value and exposures; what
    is left is regressed by its cross-product sums, so that a month may have any number of names: only its small system, one row, is solved in Python.
    """
    import numpy as np
    import pandas as pd

    root = F.sqrt(F.greatest(F.col(cap).cast("double"), F.lit(0.0)))
    ok = df.select("code", "month", F.col(value).cast("double").alias("__y"), F.col(industry).alias("__i"), root.alias("__w"), *[F.col(c).cast("double").alias(f"__{j}") for j, c in enumerate(numeric)])
    ok = ok.where(F.col("__y").isNotNull() & ~F.isnan("__y"))
    stats = ok.groupBy("month").agg(F.count(F.lit(1)).alias("__n"), F.expr("percentile(__w, array(0.01, 0.99))").alias("__clip"), *[F.median(f"__{j}").alias(f"__m{j}") for j in range(len(numeric))])
    sizes = ok.groupBy("month", "__i").agg(F.count(F.lit(1)).alias("__size"))
    x = ok.join(stats, "month").join(sizes, ["month", "__i"], "left")
    group = F.coalesce(F.when(F.col("__size") >= small, F.col("__i")), F.lit("other"))
    parts = [F.col("__y")]
    for j in range(len(numeric)):
        parts += [F.coalesce(f"__{j}", f"__m{j}", F.lit(0.0)), F.col(f"__{j}").isNull().cast("double")]
    weight = F.least(F.greatest("__w", F.col("__clip")[0]), F.col("__clip")[1])
    k = len(parts)
    x = x.select("code", "month", "__n", group.alias("__g"), weight.alias("__w"), *[c.alias(f"__v{i}") for i, c in enumerate(parts)])
    enough = x.where(F.col("__n") >= least)
    means = enough.groupBy("month", "__g").agg(*[F.coalesce(F.sum(F.col("__w") * F.col(f"__v{i}")) / F.nullif(F.sum("__w"), F.lit(0.0)), F.lit(0.0)).alias(f"__c{i}") for i in range(k)])
    inner = enough.join(means, ["month", "__g"]).select("code", "month", "__w", *[(F.col(f"__v{i}") - F.col(f"__c{i}")).alias(f"__v{i}") for i in range(k)])
    sums = inner.groupBy("month").agg(F.array(*[F.sum(F.col("__w") * F.col(f"__v{i}") * F.col(f"__v{j}")) for i in range(k) for j in range(k)]).alias("s"))

    def solve(batches):
        for pdf in batches:
            betas = []
            for s in pdf["s"]:
                m = np.array(s).reshape(k, k)
                betas.append((np.linalg.pinv(m[1:, 1:], hermitian=True) @ m[1:, 0]).tolist())
            yield pd.DataFrame({"month": pdf["month"], "beta": betas})

    beta = sums.mapInPandas(solve, f"month {dict(df.dtypes)['month']}, beta array<double>")
    residual = F.col("__v0") - sum((F.col("beta")[i - 1] * F.col(f"__v{i}") for i in range(1, k)), F.lit(0.0))
    few = x.where(F.col("__n") < least).select("code", "month", F.lit(None).cast("double").alias("residual"))
    return inner.join(beta, "month").select("code", "month", residual.alias("residual")).unionByName(few)


def screen(panel: DataFrame, least: int = 5) -> DataFrame:
    """Tiers from 2 to -2 of each month's names (code, month, market, mom, ram, trend, dd, regime): score, q, tier.

    The score is 0.45 z(mom) + 0.35 z(ram) + 0.20 trend + 0.50 z(dd), what is missing counting as 0, to nine places. Tiers go by its quantile within the market, or within
    the month where the market has fewer than ``least`` names, or are 0 where the month has so few. The ends ask for a trend of their sign. Where the
    market's regime is risk_off, positive tiers go down by one.
    """
    m = Window.partitionBy("month")
    z = lambda c: F.coalesce((F.col(c) - F.avg(c).over(m)) / F.nullif(F.stddev_pop(c).over(m), F.lit(0.0)), F.lit(0.0))
    x = panel.withColumn("score", F.round(0.45 * z("mom") + 0.35 * z("ram") + 0.2 * F.coalesce("trend", F.lit(0.0)) + 0.5 * z("dd"), 9))
    x = quantile_rank(quantile_rank(x, ["month", "market"], "score", "own"), ["month"], "score", "pool")
    names = F.count(F.lit(1))
    q = F.when(names.over(Window.partitionBy("month", "market")) >= least, F.col("own")).when(names.over(m) >= least, F.col("pool"))
    x = x.withColumn("q", q)
    up, down = F.coalesce(F.col("trend") > 0, F.lit(False)), F.coalesce(F.col("trend") < 0, F.lit(False))
    tier = F.when(F.col("q").isNull(), 0).when(F.col("q") >= 0.9, F.when(up, 2).otherwise(1)).when(F.col("q") >= 0.7, 1).when(F.col("q") < 0.1, F.when(down, -2).otherwise(-1)).when(F.col("q") < 0.3, -1).otherwise(0)
    lowered = F.when((F.col("regime") == "risk_off") & (tier > 0), tier - 1).otherwise(tier)
    return x.withColumn("tier", lowered).drop("own", "pool")


def orthogonalize(df: DataFrame, y: str, x: str, by: list[str], least: int = 3) -> DataFrame:
    """y less its regression on x within each group; groups below ``least`` keep y."""
    both = df.withColumn("__y", F.when(F.col(x).isNotNull(), F.col(y))).withColumn("__x", F.when(F.col(y).isNotNull(), F.col(x)))
    g = both.groupBy(*by).agg(F.count("__y").alias("__n"), F.regr_slope("__y", "__x").alias("__b"), F.regr_intercept("__y", "__x").alias("__a"))
    fit = F.when((F.col("__n") >= least) & F.col("__b").isNotNull(), F.col(y) - F.col("__a") - F.col("__b") * F.col(x)).otherwise(F.col(y))
    return df.join(g, by).withColumn("ortho", fit).drop("__n", "__a", "__b")


def family_composite(df: DataFrame, families: dict[str, tuple[list[str], float]], required: list[str], penalty: float = -0.5, coverage: float = 0.75) -> DataFrame:
    """Family score: equal weights, a missing optional field scores the penalty; missing required fields block. Families are weighted
    over those there are; eligible when enough fields are there and none is blocked."""
    fields = [f for fs, _ in families.values() for f in fs]
    have = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0)) / len(fields)
    blocked = F.lit(False)
    for f in required:
        blocked = blocked | F.col(f).isNull()
    out = df
    for name, (fs, _) in families.items():
        some = F.coalesce(*fs).isNotNull()
        out = out.withColumn(f"f_{name}", F.when(some, sum((F.coalesce(F.col(f), F.lit(penalty)) for f in fs), F.lit(0.0)) / len(fs)))
    num = sum((F.coalesce(F.col(f"f_{n}") * w, F.lit(0.0)) for n, (_, w) in families.items()), F.lit(0.0))
    den = sum((F.when(F.col(f"f_{n}").isNotNull(), w).otherwise(0.0) for n, (_, w) in families.items()), F.lit(0.0))
    return out.withColumn("composite", F.when(~blocked & (den > 0), num / den)).withColumn("coverage", have).withColumn("eligible", ~blocked & (have >= coverage))


def ttm(df: DataFrame, value: str) -> DataFrame:
    """Trailing year of year-to-date values: YTD + prior full year - prior same period; null if a part is missing. (code, year, quarter)."""
    prev = df.select("code", (F.col("year") + 1).alias("year"), "quarter", F.col(value).alias("same"))
    full = df.where("quarter = 4").select("code", (F.col("year") + 1).alias("year"), F.col(value).alias("full"))
    x = df.join(prev, ["code", "year", "quarter"], "left").join(full, ["code", "year"], "left")
    return x.withColumn("ttm", F.when(F.col("quarter") == 4, F.col(value)).otherwise(F.col(value) + F.col("full") - F.col("same")))


def stability(df: DataFrame, value: str, date: str, n: int = 8, least: int = 3) -> DataFrame:
    """Minus the sample deviation of the last n values, and the last value less the mean of those before."""
    x = last_rows(df.where(F.col(value).isNotNull()), n, "code", date)
    return x.groupBy("code").agg(F.when(F.count(F.lit(1)) >= least, -F.stddev_samp(value)).alias("stability"), (F.max(F.when(F.col("k") == 0, F.col(value))) - F.avg(F.when(F.col("k") > 0, F.col(value)))).alias("change"))


def rank_ic(panel: DataFrame, least: int = 5) -> DataFrame:
    """Spearman correlation of score and forward return per month, average ranks for ties."""
    x = panel.where("score is not null and fwd is not null")
    x = x.select("month", rank_avg(["month"], "score").alias("a"), rank_avg(["month"], "fwd").alias("b"))
    return x.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("ic")).where(F.col("n") >= least)


def ic_summary(ic: DataFrame) -> DataFrame:
    x = ic.withColumn("prev", F.lag("ic").over(Window.orderBy("month")))
    sd = F.stddev_samp("ic")
    return x.agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), sd.alias("std"), (F.avg("ic") / sd).alias("ir"), (F.avg("ic") / sd * F.sqrt(F.count("ic"))).alias("t"), F.avg((F.col("ic") > 0).cast("double")).alias("hit"), F.corr("ic", "prev").alias("decay"))


def _indexed(series: DataFrame, value: str, date: str) -> DataFrame:
    """One series numbered in date order (a series of evidence has a row per period)."""
    return series.where(F.col(value).isNotNull()).select(F.row_number().over(Window.orderBy(date)).alias("i"), F.col(value).alias("v"))


def autocovariances(series: DataFrame, value: str, date: str, lags: int) -> DataFrame:
    """lag, gamma = sum of (v_i - m)(v_(i-lag) - m) / n, and n, m."""
    x = _indexed(series, value, date)
    m = x.agg(F.avg("v").alias("m"), F.count("v").alias("n"))
    c = x.crossJoin(F.broadcast(m)).select("i", (F.col("v") - F.col("m")).alias("d"), "n", "m")
    lag = F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag")
    a = c.select("*", lag).withColumn("j", F.col("i") - F.col("lag"))
    b = c.select(F.col("i").alias("j"), F.col("d").alias("e"))
    return a.join(b, "j").groupBy("lag").agg((F.sum(F.col("d") * F.col("e")) / F.first("n")).alias("gamma"), F.first("n").alias("n"), F.first("m").alias("m"))


def newey_west(series: DataFrame, value: str = "ic", date: str = "month") -> DataFrame:
    """Long-run variance with Bartlett weights up to lag max(1, int(n^0.25)); t and two-sided p of the mean."""
    g = autocovariances(series, value, date, 12)
    lag_max = F.greatest(F.lit(1), F.floor(F.pow("n", F.lit(0.25))))
    weight = F.when(F.col("lag") == 0, 1.0).when(F.col("lag") <= lag_max, 2 * (1 - F.col("lag") / (lag_max + 1))).otherwise(0.0)
    x = g.agg(F.max("n").alias("n"), F.max("m").alias("mean"), F.sum(weight * F.col("gamma")).alias("lrv"))
    t = F.col("mean") / F.sqrt(F.col("lrv") / F.col("n"))
    return x.select("n", "mean", "lrv", t.alias("t"), (2 * (1 - normal_cdf(F.abs(t)))).alias("p"))


def effective_n(series: DataFrame, value: str = "ic", date: str = "month") -> DataFrame:
    """n (1 - rho) / (1 + rho) with the first autocorrelation, within [1, n]."""
    g = autocovariances(series, value, date, 1)
    x = g.agg(F.max("n").alias("n"), F.max(F.when(F.col("lag") == 1, F.col("gamma"))).alias("g1"), F.max(F.when(F.col("lag") == 0, F.col("gamma"))).alias("g0"))
    rho = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.col("g1") / F.col("g0")))
    return x.select("n", rho.alias("rho"), F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), F.col("n") * (1 - rho) / (1 + rho))).alias("effective"))


def block_bootstrap(series: DataFrame, value: str, date: str, samples: int, block: int, seed: str = "s") -> DataFrame:
    """Circular block bootstrap of the mean: replicate, mean. Block starts come from md5 digests of (seed, replicate, block)."""
    x = _indexed(series, value, date)
    n = x.agg(F.count("v").alias("n"))
    reps = x.sparkSession.range(samples).withColumnRenamed("id", "replicate").crossJoin(F.broadcast(n))
    blocks = reps.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)).alias("b"))
    start = F.conv(F.substring(F.md5(F.concat_ws(",", F.lit(seed), "replicate", "b")), 1, 8), 16, 10).cast("long") % F.col("n")
    rows = blocks.select("replicate", "n", "b", start.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("k")).where(F.col("b") * block + F.col("k") < F.col("n"))
    return rows.withColumn("i", ((F.col("s") + F.col("k")) % F.col("n") + 1).cast("int")).join(F.broadcast(x), "i").groupBy("replicate").agg(F.avg("v").alias("mean"))


def bootstrap_ci(means: DataFrame, samples: int) -> DataFrame:
    """Order statistics at int(0.025 (B - 1)) and int(0.975 (B - 1)), not interpolated."""
    k = F.row_number().over(Window.orderBy("mean", "replicate")) - 1
    lo, hi = int(0.025 * (samples - 1)), int(0.975 * (samples - 1))
    return means.withColumn("k", k).agg(F.max(F.when(F.col("k") == lo, F.col("mean"))).alias("lo"), F.max(F.when(F.col("k") == hi, F.col("mean"))).alias("hi"))


def fdr_bh(df: DataFrame, p: str, key: str) -> DataFrame:
    """Benjamini-Hochberg q values: running minimum of p n / rank from the largest p.

    Ranges of p are dealt to partitions and written; ranks and minima within a range are carried on by one row per range, so no task
    sees all rows.
    """
    x = written(df.repartitionByRange(p, key).withColumn("range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("range")
    sizes = x.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("before", F.sum("size").over(Window.orderBy("range")) - F.col("size"))
    total = x.agg(F.count(F.lit(1)).alias("n"))
    ranked = x.join(sizes, "range").crossJoin(total).withColumn("rank", (F.row_number().over(own.orderBy(p, key)) + F.col("before")).cast("int")).withColumn("raw", F.col(p) * F.col("n") / F.col("rank"))
    least = ranked.groupBy("range").agg(F.min("raw").alias("least"))
    later = least.select("range", F.min("least").over(Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    q = F.min("raw").over(own.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.join(later, "range").withColumn("q", F.least(F.lit(1.0), q, "later")).select(*df.columns, "rank", "q")


def sharpe_tests(df: DataFrame, by: str, ret: str = "ret", trials: int = 10, confidence: float = 0.95) -> DataFrame:
    """Probabilistic and deflated Sharpe ratio and the minimum track record, with population skewness and excess kurtosis."""
    g = df.where(F.col(ret).isNotNull()).groupBy(by).agg(F.count(ret).alias("n"), (F.avg(ret) / F.stddev_samp(ret)).alias("sr"), F.skewness(ret).alias("skew"), F.kurtosis(ret).alias("kurt"))
    var = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") + 2) / 4 * F.col("sr") * F.col("sr")
    psr = normal_cdf(F.col("sr") * F.sqrt(F.col("n") - 1) / F.sqrt(F.greatest(var, F.lit(1e-12))))
    hurdle = F.sqrt(F.greatest(var, F.lit(1e-12)) / (F.col("n") - 1)) * ((1 - 0.5772156649) * normal_ppf(F.lit(1 - 1 / trials)) + 0.5772156649 * normal_ppf(F.lit(1 - 1 / (trials * 2.718281828459045))))
    dsr = normal_cdf((F.col("sr") - hurdle) * F.sqrt(F.col("n") - 1) / F.sqrt(F.greatest(var, F.lit(1e-12))))
    z = normal_ppf(F.lit(confidence))
    return g.select(by, "n", "sr", psr.alias("psr"), dsr.alias("dsr"), F.when(F.col("sr") > 0, 1 + var * F.pow(z / F.col("sr"), 2)).alias("min_track"))


def pbo(perf: DataFrame, splits: DataFrame) -> DataFrame:
    """Per split: the best in-sample trial (ties: the larger name), its relative rank out of sample, min((below + (equal + 1) / 2) / n, 1), the logit of
    the rank, whether it is overfit (below one half), and what it loses out of sample. ``splits`` has split, period, inside; it is a constant
    of the number of periods."""
    m = perf.join(F.broadcast(splits), "period").groupBy("split", "trial").agg(F.avg(F.when(F.col("inside"), F.col("performance"))).alias("ins"), F.avg(F.when(~F.col("inside"), F.col("performance"))).alias("oos"))
    best = m.groupBy("split").agg(F.max_by(F.struct("trial", "ins", "oos"), F.struct("ins", "trial")).alias("b"))
    j = m.join(best, "split").groupBy("split", "b").agg(F.sum((F.col("oos") < F.col("b.oos")).cast("int")).alias("below"), F.sum((F.col("oos") == F.col("b.oos")).cast("int")).alias("equal"), F.count(F.lit(1)).alias("n"))
    j = j.withColumn("rel_rank", F.least(F.lit(1.0), (F.col("below") + 0.5 * (F.col("equal") + 1)) / F.col("n")))
    inside = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), "rel_rank"))
    return j.select("split", F.col("b.trial").alias("trial"), "rel_rank", F.log(inside / (1 - inside)).alias("logit"), (F.col("rel_rank") < 0.5).alias("overfit"), (F.col("b.oos") - F.col("b.ins")).alias("degradation"))


def pbo_summary(per_split: DataFrame) -> DataFrame:
    """Probability of backtest overfitting, mean out-of-sample degradation and the upper median logit over the splits of ``pbo``."""
    n = F.count(F.lit(1))
    logits = F.array_sort(F.collect_list("logit"))
    return per_split.agg(n.alias("splits"), F.avg(F.col("overfit").cast("double")).alias("pbo"), F.avg("degradation").alias("mean_degradation"), F.element_at(logits, (F.floor(n / 2) + 1).cast("int")).alias("median_logit"))


def correlations(df: DataFrame, name: str, at: str, value: str, least: int = 3) -> DataFrame:
    """Pearson correlation of each pair of series (a <= b) over common dates."""
    a = df.select(F.col(name).alias("a"), at, F.col(value).alias("x"))
    b = df.select(F.col(name).alias("b"), at, F.col(value).alias("y"))
    g = a.join(b, at).where("a <= b and x is not null and y is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("c"))
    return g.select("a", "b", F.when(F.col("n") >= least, F.col("c")).alias("corr"))


def effective_trials(df: DataFrame, name: str, at: str, value: str) -> DataFrame:
    """n^2 / sum of squared correlations: the trace identity for the eigenvalues."""
    c = correlations(df, name, at, value)
    sq = F.sum(F.when(F.col("a") == F.col("b"), 1.0).otherwise(2 * F.coalesce("corr", F.lit(0.0)) * F.coalesce("corr", F.lit(0.0))))
    n = F.sum((F.col("a") == F.col("b")).cast("int"))
    return c.agg(n.alias("n"), (n * n / sq).alias("effective"))


def active_alpha(df: DataFrame, by: str) -> DataFrame:
    """Active mean, information ratio, and alpha and beta against the benchmark (ret, bench)."""
    x = df.where("ret is not null and bench is not null").withColumn("active", F.col("ret") - F.col("bench"))
    sd = F.stddev_samp("active")
    return x.groupBy(by).agg(F.avg("active").alias("active_mean"), F.when(sd > 0, F.avg("active") / sd * F.sqrt(F.lit(252.0))).alias("ir"), F.regr_intercept("ret", "bench").alias("alpha"), F.regr_slope("ret", "bench").alias("beta"))


def stability_slices(df: DataFrame, ret: str = "ret", benchmark: str = "proxy", n: int = 60, least: int = 20, high_vol: float = 0.30, move: float = 0.05) -> DataFrame:
    """Per code: active return compounded (as a logarithm) over each year, each market regime and all days (year and regime null).

    The regime of a day comes from at most ``n`` benchmark returns before it, none of its own or later; with fewer than ``least`` it is warmup.
    """
    w = Window.partitionBy("code").orderBy("trade_date").rowsBetween(-n, -1)
    b = F.col(benchmark)
    trend, vol = F.sum(F.log(F.greatest(F.lit(1e-6), 1 + b))).over(w), F.stddev_samp(b).over(w) * F.sqrt(F.lit(252.0))
    x = df.where(F.col(ret).isNotNull() & b.isNotNull()).select("code", "trade_date", ret, benchmark, F.count(b).over(w).alias("n"), (F.exp(trend) - 1).alias("trend"), vol.alias("vol"))
    label = F.when(F.col("n") < least, "warmup").when(F.col("vol") >= high_vol, "high_volatility").when(F.col("trend") >= move, "bull").when(F.col("trend") <= -move, "bear").otherwise("sideways")
    x = x.select("code", F.year("trade_date").cast("long").alias("year"), label.alias("regime"), F.log(F.greatest(F.lit(1e-6), 1 + F.col(ret) - b)).alias("a"))
    return x.groupingSets([["code", "year"], ["code", "regime"], ["code"]], "code", "year", "regime").agg(F.count(F.lit(1)).alias("days"), F.sum("a").alias("log_active"))


def stability_gate(slices: DataFrame, days: int = 20, worst_year: float = -0.05, worst_regime: float = -0.05, without_best: float = 0.0) -> DataFrame:
    """Of ``stability_slices``: the worst year, the worst regime of at least ``days`` days (warmup apart), what is left without the best year, and whether all
    three pass. Codes that have no such regime do not pass."""
    a, year, regime = F.expm1("log_active"), F.col("year").isNotNull(), F.col("regime").isNotNull()
    g = slices.groupBy("code").agg(
        F.min(F.when(year, a)).alias("worst_year"), F.min(F.when(regime & (F.col("regime") != "warmup") & (F.col("days") >= days), a)).alias("worst_regime"),
        F.max(F.when(~year & ~regime, F.col("log_active"))).alias("__all"), F.max(F.when(year, F.col("log_active"))).alias("__best"), F.count_if(year).alias("__years"),
    )
    g = g.withColumn("without_best", F.when(F.col("__years") > 1, F.expm1(F.col("__all") - F.col("__best"))))
    ok = (F.col("worst_year") >= worst_year) & (F.col("worst_regime") >= worst_regime) & (F.col("without_best") > without_best)
    return g.select("code", "worst_year", "worst_regime", "without_best", F.coalesce(ok, F.lit(False)).alias("passed"))


def folds(days: DataFrame, train: int, validation: int, purge: int, embargo: int) -> DataFrame:
    """Expanding folds: fold, role (train, validation), first and last day. Training ends ``purge`` days before validation; the next fold starts ``embargo`` days after it."""
    x = days.select("trade_date").distinct().withColumn("i", F.row_number().over(Window.orderBy("trade_date")) - 1)
    n = x.agg(F.count(F.lit(1)).alias("n"))
    step = validation + embargo
    k = n.select(F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - train - purge - validation) / step)).cast("int"))).alias("fold"), "n")
    k = k.withColumn("v0", train + purge + F.col("fold") * step).where(F.col("v0") + validation <= F.col("n"))
    spans = k.select("fold", F.explode(F.array(F.struct(F.lit("train").alias("role"), F.lit(0).alias("a"), (F.col("v0") - purge - 1).alias("b")), F.struct(F.lit("validation").alias("role"), F.col("v0").alias("a"), (F.col("v0") + validation - 1).alias("b")))).alias("s")).select("fold", "s.*")
    return spans.join(x, (F.col("i") == F.col("a")) | (F.col("i") == F.col("b"))).groupBy("fold", "role").agg(F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"))


def psi(base: DataFrame, current: DataFrame, value: str, by: str, bins: int = 10) -> DataFrame:
    """Population stability index per group on quantile bins of the baseline (bounds are order statistics)."""
    w = Window.partitionBy(by)
    x = base.where(F.col(value).isNotNull()).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("k", F.row_number().over(w.orderBy(value)))
    bounds = x.groupBy(by).agg(F.array_sort(F.collect_list(F.when(F.expr(f"exists(sequence(1, {bins - 1}), b -> k = n * b div {bins})"), F.col(value)))).alias("bounds"))
    count = lambda df, name: df.where(F.col(value).isNotNull()).join(bounds, by).groupBy(by, F.size(F.filter("bounds", lambda b: b < F.col(value))).alias("bin")).agg(F.count(F.lit(1)).alias(name))
    j = count(base, "b").join(count(current, "c"), [by, "bin"], "full")
    tb, tc = F.sum("b").over(w), F.sum("c").over(w)
    pb, pc = F.greatest(F.coalesce(F.col("b") / tb, F.lit(0.0)), F.lit(1e-4)), F.greatest(F.coalesce(F.col("c") / tc, F.lit(0.0)), F.lit(1e-4))
    return j.select(by, ((pc - pb) * F.log(pc / pb)).alias("t")).groupBy(by).agg(F.sum("t").alias("psi"))


def brinson(portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Allocation, selection and interaction per industry (industry, weight, ret); a side that is missing weighs 0."""
    p = portfolio.select("industry", F.col("weight").alias("wp"), F.col("ret").alias("rp"))
    b = benchmark.select("industry", F.col("weight").alias("wb"), F.col("ret").alias("rb"))
    total = b.agg(F.sum(F.col("wb") * F.col("rb")).alias("total"))
    x = p.join(b, "industry", "full").crossJoin(F.broadcast(total))
    x = x.select("industry", "total", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("wp", "wb")], F.coalesce("rp", "rb").alias("rp"), F.coalesce("rb", "rp").alias("rb"))
    return x.select("industry", ((F.col("wp") - F.col("wb")) * (F.col("rb") - F.col("total"))).alias("allocation"), (F.col("wb") * (F.col("rp") - F.col("rb"))).alias("selection"), ((F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb"))).alias("interaction"))


def carino(contrib: DataFrame) -> DataFrame:
    """Period contributions (period, name, c) linked so that they add up to the compounded total."""
    r = contrib.groupBy("period").agg(F.sum("c").alias("r"))
    k = F.when(F.abs("r") < 1e-12, 1.0).otherwise(F.log1p("r") / F.col("r"))
    total = r.agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("total"), F.sum(F.log1p("r")).alias("logs"))
    scale = F.when(F.abs("logs") < 1e-12, 1.0).otherwise(F.col("total") / F.col("logs"))
    return contrib.join(F.broadcast(r.select("period", k.alias("k"))), "period").crossJoin(F.broadcast(total.select(scale.alias("scale")))).groupBy("name").agg(F.sum(F.col("c") * F.col("k") * F.col("scale")).alias("linked"))


def tail_risk(df: DataFrame, by: str, ret: str = "ret", share: float = 0.05) -> DataFrame:
    """Value at risk, mean beyond it, and the mean of the worst drawdowns, of the worst ceil(share n) rows."""
    x = df.where(F.col(ret).isNotNull())
    upto = Window.partitionBy(by).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("path", F.sum(F.log(F.greatest(1 + F.col(ret), F.lit(1e-6)))).over(upto))
    x = x.withColumn("dd", F.col("path") - F.greatest(F.lit(0.0), F.max("path").over(upto)))
    x = x.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(by))).withColumn("a", F.row_number().over(Window.partitionBy(by).orderBy(ret, "trade_date"))).withColumn("b", F.row_number().over(Window.partitionBy(by).orderBy("dd", "trade_date")))
    m = F.ceil(share * F.col("n"))
    return x.groupBy(by).agg((-F.max(F.when(F.col("a") == m, F.col(ret)))).alias("var"), (-F.avg(F.when(F.col("a") <= m, F.col(ret)))).alias("cvar"), (-F.avg(F.when(F.col("b") <= m, F.col("dd")))).alias("cdar"))


def stress(positions: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Loss per scenario and its largest contributor. ``scenarios`` (scenario, industry or null for all, shock) is a constant table."""
    s = F.broadcast(scenarios.withColumnRenamed("industry", "__i"))
    x = positions.join(s, F.col("__i").isNull() | (F.col("__i") == F.col("industry"))).withColumn("loss", F.col("weight") * F.col("shock"))
    return x.groupBy("scenario").agg(F.sum("loss").alias("total"), F.min_by("code", F.struct("loss", "code")).alias("worst"))


def ewma_covariance(df: DataFrame, name: str, at: str, value: str, decay: float = 0.94) -> DataFrame:
    """Covariance of each pair (a <= b) with weights decay^age over the dates in order of age."""
    age = df.select(at).distinct().withColumn("w", F.pow(F.lit(decay), F.row_number().over(Window.orderBy(F.desc(at))) - 1))
    x = df.where(F.col(value).isNotNull()).join(F.broadcast(age), at)
    mean = x.groupBy(name).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    c = x.join(mean, name).select(name, at, "w", (F.col(value) - F.col("m")).alias("d"))
    a, b = c.withColumnRenamed(name, "a"), c.select(F.col(name).alias("b"), at, F.col("d").alias("e"))
    return a.join(b, at).where("a <= b").groupBy("a", "b").agg((F.sum(F.col("w") * F.col("d") * F.col("e")) / F.sum("w")).alias("cov"))


def factor_returns(df: DataFrame, at: str, ret: str, exposures: list[str], weight: str) -> DataFrame:
    """Weighted least squares factor returns (weights are roots) and specific variance of each date.

    The normal equations are sums, so a cross-section may have any size; only the small system of a date, one row, is solved in Python.
    """
    import numpy as np
    import pandas as pd

    names = ["intercept", *exposures]
    ok = df.select(at, F.col(ret).alias("__y"), F.sqrt(F.greatest(F.col(weight).cast("double"), F.lit(0.0))).alias("__w"), F.array(F.lit(1.0), *(F.col(e).cast("double") for e in exposures)).alias("__x"))
    ok = ok.where(F.col("__y").isNotNull() & F.col("__w").isNotNull() & ~F.exists("__x", lambda v: v.isNull()))
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cell = lambda i, j: F.sum(F.col("__w") * F.col("__x")[i] * F.col("__x")[j])
    sums = ok.groupBy(at).agg(F.array(*[cell(i, j) for i, j in pairs]).alias("a"), F.array(*[F.sum(F.col("__w") * F.col("__x")[i] * F.col("__y")) for i in range(k)]).alias("b"))

    def solve(batches):
        for pdf in batches:
            betas = []
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                m = np.zeros((k, k))
                for (i, j), v in zip(pairs, a, strict=True):
                    m[i, j] = m[j, i] = v
                betas.append((np.linalg.pinv(m, hermitian=True) @ np.asarray(b, dtype=float)).tolist())
            yield pd.DataFrame({at: pdf[at], "beta": betas})

    beta = sums.mapInPandas(solve, f"{at} {dict(df.dtypes)[at]}, beta array<double>")
    fit = sum((F.col("beta")[i] * F.col("__x")[i] for i in range(k)), F.lit(0.0))
    spec = ok.join(beta, at).groupBy(at).agg(F.var_pop(F.col("__y") - fit).alias("specific_var"), F.first("beta").alias("beta"))
    parts = F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("factor"), F.col("beta").alias("factor_return"))).alias("f")
    return spec.select(at, "specific_var", parts).select(at, "f.factor", "f.factor_return", "specific_var")


def portfolio_risk(covariance: DataFrame, weights: DataFrame, name: str) -> DataFrame:
    """Variance of a book, each part's share of it, and tracking error against a benchmark. ``covariance`` has pairs a <= b, cov; ``weights`` name, weight, benchmark."""
    both = covariance.select("a", "b", "cov").unionByName(covariance.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "cov"))
    other = weights.select(F.col(name).alias("b"), F.col("weight").alias("wb"), (F.col("weight") - F.col("benchmark")).alias("tb"))
    x = both.join(other, "b").groupBy("a").agg(F.sum(F.col("cov") * F.col("wb")).alias("mp"), F.sum(F.col("cov") * F.col("tb")).alias("mt"))
    x = x.join(weights.withColumnRenamed(name, "a"), "a").withColumns({"own": F.col("weight") * F.col("mp"), "off": (F.col("weight") - F.col("benchmark")) * F.col("mt")})
    total = x.agg(F.sum("own").alias("variance"), F.sqrt(F.greatest(F.lit(0.0), F.sum("off"))).alias("tracking_error"))
    return x.crossJoin(total).select(F.col("a").alias(name), "weight", "variance", (F.col("own") / F.col("variance")).alias("contribution"), "tracking_error")


def liquidation_days(positions: DataFrame, value: str, adv: str, tradable: str, participation: float = 0.10, stressed: float = 0.30) -> DataFrame:
    """Days to sell a position at a share of the daily amount, and of that under stress; what cannot be traded has no stress days."""
    days = lambda part: F.abs(value) / F.greatest(F.col(adv) * part, F.lit(1.0))
    return positions.withColumns({"normal_days": days(participation), "stress_days": F.when(F.col(tradable), days(participation * stressed))})


def account_bridge(trades: DataFrame, cash: DataFrame, account: str, industry: str, style: str, warn: float = 0.001) -> DataFrame:
    """Total return of each account split into market, industry, style, selection, cash drag, fees and slippage; what is left over is the residual, with a
    warning above ``warn``. ``trades`` has gross, ret, fees and slippage (amounts) beside the keys, ``cash`` the account's idle cash.

    The total is the gain after fees and slippage over the amount in positions and cash. Means by industry and style are one row per member of a dimension.
    """
    mean = lambda df, by, name: df.groupBy(*by).agg((F.sum(F.col("gross") * F.col("ret")) / F.sum("gross")).alias(name))
    x = trades.join(mean(trades, [industry], "i"), industry).join(mean(trades, [style], "s"), style).crossJoin(mean(trades, [], "m"))
    part = lambda c: F.sum(F.col("gross") * c) / F.sum("gross")
    a = x.groupBy(account).agg(
        F.first("m").alias("market"), part(F.col("i") - F.col("m")).alias("industry"), part(F.col("s") - F.col("m")).alias("style"), part(F.col("ret") - F.col("i") - F.col("s") + F.col("m")).alias("selection"),
        F.sum("gross").alias("gross"), F.sum(F.col("gross") * F.col("ret")).alias("gain"), F.sum("fees").alias("paid"), F.sum("slippage").alias("slipped"),
    )
    y = a.join(cash, account).withColumn("all", F.col("gross") + F.col("cash"))
    invested = F.col("gross") / F.col("all")
    y = y.withColumns({"total": (F.col("gain") - F.col("paid") - F.col("slipped")) / F.col("all"), "cash_drag": (invested - 1) * (F.col("market") + F.col("industry") + F.col("style") + F.col("selection")), "fees": -F.col("paid") / F.col("gross") * invested, "slippage": -F.col("slipped") / F.col("gross") * invested})
    residual = F.col("total") - sum((F.col(c) for c in ("selection", "industry", "style", "market", "cash_drag", "fees", "slippage")), F.lit(0.0))
    return y.withColumn("residual", residual).withColumn("warning", F.abs("residual") > warn).select(account, "total", "selection", "industry", "style", "market", "cash_drag", "fees", "slippage", "residual", "warning")
