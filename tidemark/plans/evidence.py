"""Queries of cross-section models, factor evidence, top-k and set operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import evidence as E
from tidemark.operators import factors as FA
from tidemark.operators import series as S
from tidemark.operators.monthly import month_panel
from tidemark.plans.base import BARS, FIGURES, MEMBERS, VALUATIONS, bars, figures, members, r6, table, valuations
from tidemark.plans.series import FWD, RET, monthly, panel, rets
from tidemark.sources import lake as L

QUERIES: dict = {}
ORACLES: dict = {}


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: Returns clipped to +-0.5, as the synthetic prices jump.
CLIP = f"{RET}, c AS (SELECT code, trade_date, greatest(-0.5, least(0.5, ret)) AS ret FROM rets WHERE ret IS NOT NULL)"


def clipped(spark, d):
    return rets(spark, d).where("ret is not null").select("code", "trade_date", F.greatest(F.lit(-0.5), F.least(F.lit(0.5), "ret")).alias("ret"))


PROXY = f"{CLIP}, p AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY trade_date) >= 5 THEN (sum(ret) OVER (PARTITION BY trade_date) - ret) / (count(*) OVER (PARTITION BY trade_date) - 1) END AS proxy FROM c)"


def proxied(spark, d):
    return E.leave_one_out(clipped(spark, d), ["trade_date"])


@q("fac_leave_one_out_proxy", f"WITH {PROXY} SELECT code, trade_date, round(proxy, 6) AS proxy FROM p")
def _(spark, d):
    return proxied(spark, d).select("code", "trade_date", *r6("proxy"))


LAST = f"{PROXY}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) - 1 AS k FROM p WHERE proxy IS NOT NULL) WHERE k < 252), b AS (SELECT code, count(*) AS n, regr_intercept(ret, proxy) AS alpha, regr_slope(ret, proxy) AS beta, regr_r2(ret, proxy) AS r2 FROM l GROUP BY code HAVING count(*) >= 60)"


@q("fac_beta_residual", f"WITH {LAST} SELECT code, n, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(r2, 6) AS r2 FROM b")
def _(spark, d):
    return E.beta(proxied(spark, d)).select("code", "n", *r6("alpha", "beta", "r2"))


@q("fac_residual_momentum", f"WITH {LAST}, e AS (SELECT code, k, ret - alpha - beta * proxy AS e FROM l JOIN b USING (code)) SELECT code, round(sum(ln(greatest(1 + e, 1e-6))) FILTER (WHERE k >= 21), 6) AS residual_momentum, round(stddev_samp(e) FILTER (WHERE k < 120), 6) AS residual_vol FROM e GROUP BY code")
def _(spark, d):
    return E.residual_momentum(E.residuals(proxied(spark, d))).select("code", *r6("residual_momentum", "residual_vol"))


RAW = f"""{RET}, raw AS (SELECT code, trade_date, close / lag(close, 120) OVER w - 1 AS mom, -(close / lag(close, 5) OVER w - 1) AS rev, stddev_samp(ret) OVER (PARTITION BY code ORDER BY trade_date ROWS 59 PRECEDING) AS vol, close / max(close) OVER (PARTITION BY code ORDER BY trade_date ROWS 119 PRECEDING) - 1 AS dd,
 row_number() OVER (PARTITION BY code, date_trunc('month', trade_date) ORDER BY trade_date DESC) AS k FROM rets WINDOW w AS (PARTITION BY code ORDER BY trade_date)),
 rawm AS (SELECT code, CAST(date_trunc('month', trade_date) AS DATE) AS month, mom, rev, vol, dd FROM raw WHERE k = 1)"""


def raw_panel(spark, d):
    return month_panel(bars(spark, d)).select("code", "month", "mom", "rev", "vol", "dd")


def forward_panel(spark, d):
    """The raw panel with the return to the next month's close (null: none), both from one pass over the bars."""
    x = month_panel(bars(spark, d), ["mom", "rev", "vol", "dd", "close"])
    fwd = F.lead("close").over(Window.partitionBy("code").orderBy("month")) / F.col("close") - 1
    return x.select("code", "month", "mom", "rev", "vol", "dd", F.when(F.col("code").isNotNull(), fwd).alias("fwd"))


FULL_PANEL = f"""{RET}, {FIGURES}, {VALUATIONS}, {MEMBERS},
 pa AS (SELECT code, trade_date, close, row_number() OVER w AS i, lag(close, 21) OVER w AS c21, lag(close, 126) OVER w AS c126, lag(close, 252) OVER w AS c252, avg(close) OVER r20 AS ma20, avg(close) OVER r60 AS ma60, stddev_samp(ret) OVER r60 AS v60, stddev_samp(ret) OVER r120 AS v120, lead(trade_date) OVER w AS nxt
  FROM rets WINDOW w AS (PARTITION BY code ORDER BY trade_date), r20 AS (PARTITION BY code ORDER BY trade_date ROWS 19 PRECEDING), r60 AS (PARTITION BY code ORDER BY trade_date ROWS 59 PRECEDING), r120 AS (PARTITION BY code ORDER BY trade_date ROWS 119 PRECEDING)),
 pe AS (SELECT * FROM pa WHERE nxt IS NULL OR date_trunc('month', nxt) > date_trunc('month', trade_date)),
 pf AS (SELECT e.code, e.trade_date, x.i, x.close, max(x.close) OVER (PARTITION BY e.code, e.trade_date ORDER BY x.i) AS peak FROM pe e JOIN pa x ON x.code = e.code AND x.i BETWEEN e.i - 119 AND e.i WHERE e.i >= 120),
 dd AS (SELECT code, trade_date, min(close / peak - 1) AS max_drawdown_120 FROM pf GROUP BY 1, 2),
 qa AS (SELECT *, CASE WHEN count(roe) OVER e >= 3 THEN -stddev_samp(roe) OVER e END AS earnings_stability, net_margin - lag(net_margin) OVER (PARTITION BY code ORDER BY available_at, period) AS margin_change, CASE WHEN net_income >= 1000000 THEN cash / net_income END AS ocf_to_profit,
  CASE WHEN assets > 0 THEN (cash - net_income) / assets END AS cash_conversion_assets, CASE WHEN net_income <= 0 THEN -1.0 ELSE 0.0 END AS loss_profitability FROM figures WINDOW e AS (PARTITION BY code ORDER BY available_at, period ROWS 7 PRECEDING)),
 va AS (SELECT *, CASE WHEN ep IS NULL THEN bp WHEN bp IS NULL THEN ep ELSE (ep + bp) / 2 END AS v FROM valuations),
 vb AS (SELECT a.code, a.available_at, any_value(a.ep) AS ep, any_value(a.bp) AS bp, any_value(a.market_cap) AS market_cap, CASE WHEN count(b.v) >= 24 AND any_value(a.v) IS NOT NULL THEN (sum((b.v < a.v)::INT) + 0.5 * sum((b.v = a.v)::INT)) / count(b.v) END AS valuation_percentile FROM va a JOIN va b ON b.code = a.code AND b.available_at <= a.available_at GROUP BY 1, 2),
 pj AS (SELECT pe.*, q.* EXCLUDE (code, period, available_at) FROM pe ASOF LEFT JOIN qa q ON q.code = pe.code AND pe.trade_date >= q.available_at),
 pk AS (SELECT pj.*, v.ep, v.bp, v.market_cap, v.valuation_percentile, v2.max_drawdown_120, m.market = 'ASIA' AS fin FROM pj ASOF LEFT JOIN vb v ON v.code = pj.code AND pj.trade_date >= v.available_at LEFT JOIN dd v2 ON v2.code = pj.code AND v2.trade_date = pj.trade_date LEFT JOIN members m ON m.code = pj.code)"""
ROUNDED = {
    "momentum_12_1": "c21 / c252 - 1", "momentum_6_1": "c21 / c126 - 1", "short_reversal": "-(close / c21 - 1)", "residual_momentum": "c21 / c252 - c21 / c126",
    "trend": "CASE WHEN i >= 60 THEN ((CASE WHEN close >= ma20 THEN 1 ELSE -1 END) + (CASE WHEN close >= ma60 THEN 1 ELSE -1 END) + (CASE WHEN ma20 >= ma60 THEN 1 ELSE -1 END)) / 3.0 WHEN i >= 20 THEN CASE WHEN close >= ma20 THEN 1 ELSE -1 END END",
    "volatility_60": "CASE WHEN i >= 61 THEN -v60 END", "volatility_120": "CASE WHEN i >= 121 THEN -v120 END", "max_drawdown_120": "max_drawdown_120", "roe": "roe", "earnings_stability": "earnings_stability", "loss_profitability": "loss_profitability",
    **{c: f"CASE WHEN NOT fin THEN {c} END" for c in ["gross_margin", "net_margin", "ocf_to_profit", "cash_conversion_assets", "margin_change", "debt_ratio"]}, "accruals": "CASE WHEN NOT fin THEN -cash_conversion_assets END",
    "financial_roe": "CASE WHEN fin THEN roe END", "ep": "ep", "bp": "bp", "market_cap": "market_cap", "valuation_percentile": "valuation_percentile",
}


@q("fac_raw_panel", f"WITH {FULL_PANEL} SELECT code, trade_date, {', '.join(f'round({x}, 6) AS {c}' for c, x in ROUNDED.items())} FROM pk")
def _(spark, d):
    """Price, quality and value factors of each supplier at each month's last bar; the suppliers of one region stand for firms of finance."""
    firms = members(spark, d).select("code", (F.col("market") == "ASIA").alias("finance"))
    x = FA.factor_panel(bars(spark, d), firms, figures(spark, d), valuations(spark, d))
    return x.select("code", "trade_date", *r6(*ROUNDED))


@q("fac_neutralize_wls")
def _(spark, d):
    # Written, as sizes, quantiles, means and sums are all taken from it.
    x = L.written(raw_panel(spark, d).join(members(spark, d), "code").select("code", "month", "mom", "vol", "industry", "cap", F.log("cap").alias("log_cap")), "panel")
    return E.neutralize_wls(x, "mom", "industry", ["log_cap", "vol"], "cap").select("code", "month", *r6("residual"))


@q("fac_industry_neutral", f"""WITH {RAW}, {MEMBERS}, x AS (SELECT r.code, month, market, vol FROM rawm r JOIN members USING (code) WHERE vol IS NOT NULL),
 c AS (SELECT month, market, quantile_cont(vol, 0.01) AS lo, quantile_cont(vol, 0.99) AS hi, count(*) AS n FROM x GROUP BY 1, 2), y AS (SELECT code, month, market, CASE WHEN n >= 8 THEN greatest(lo, least(hi, vol)) ELSE vol END AS v FROM x JOIN c USING (month, market))
 SELECT code, month, round(CASE WHEN count(*) OVER g < 2 OR stddev_pop(v) OVER g = 0 THEN 0 ELSE (v - avg(v) OVER g) / stddev_pop(v) OVER g END, 6) AS z FROM y WINDOW g AS (PARTITION BY month, market)""")
def _(spark, d):
    # Written, as quantiles and values are both taken from it.
    x = L.written(raw_panel(spark, d).join(members(spark, d), "code").where("vol is not null").select("code", "month", "market", "vol"), "panel")
    return S.zscore(S.winsorize(x, ["month", "market"], "vol"), ["month", "market"], "clipped").select("code", "month", *r6("z"))


@q("fac_orthogonalize", f"""WITH {RAW}, {MEMBERS}, x AS (SELECT r.*, market FROM rawm r JOIN members USING (code)), g AS (SELECT month, market, count(*) AS n, regr_slope(dd, mom) AS b, regr_intercept(dd, mom) AS a FROM x WHERE dd IS NOT NULL AND mom IS NOT NULL GROUP BY 1, 2)
 SELECT code, x.month, round(CASE WHEN n >= 3 AND b IS NOT NULL AND NOT isnan(b) THEN dd - a - b * mom ELSE dd END, 6) AS ortho FROM x LEFT JOIN g ON g.month = x.month AND g.market = x.market""")
def _(spark, d):
    x = raw_panel(spark, d).join(members(spark, d).select("code", "market"), "code")
    return E.orthogonalize(x, "dd", "mom", ["month", "market"]).select("code", "month", *r6("ortho"))


@q("fac_family_composite", f"""WITH {RAW}, z AS (SELECT code, month, (mom - avg(mom) OVER m) / nullif(stddev_pop(mom) OVER m, 0) AS mom, (rev - avg(rev) OVER m) / nullif(stddev_pop(rev) OVER m, 0) AS rev, (vol - avg(vol) OVER m) / nullif(stddev_pop(vol) OVER m, 0) AS vol, (dd - avg(dd) OVER m) / nullif(stddev_pop(dd) OVER m, 0) AS dd FROM rawm WINDOW m AS (PARTITION BY month)),
 f AS (SELECT *, CASE WHEN mom IS NOT NULL OR rev IS NOT NULL THEN (coalesce(mom, -0.5) + coalesce(rev, -0.5)) / 2 END AS a, CASE WHEN vol IS NOT NULL OR dd IS NOT NULL THEN (coalesce(vol, -0.5) + coalesce(dd, -0.5)) / 2 END AS b FROM z)
 SELECT code, month, round(CASE WHEN dd IS NOT NULL AND (a IS NOT NULL OR b IS NOT NULL) THEN (coalesce(0.6 * a, 0) + coalesce(0.4 * b, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b IS NULL THEN 0 ELSE 0.4 END) END, 6) AS composite,
  round(((mom IS NOT NULL)::INT + (rev IS NOT NULL)::INT + (vol IS NOT NULL)::INT + (dd IS NOT NULL)::INT) / 4.0, 6) AS coverage, dd IS NOT NULL AND ((mom IS NOT NULL)::INT + (rev IS NOT NULL)::INT + (vol IS NOT NULL)::INT + (dd IS NOT NULL)::INT) / 4.0 >= 0.75 AS eligible FROM f""")
def _(spark, d):
    m = Window.partitionBy("month")
    z = raw_panel(spark, d).select("code", "month", *[((F.col(c) - F.avg(c).over(m)) / F.nullif(F.stddev_pop(c).over(m), F.lit(0.0))).alias(c) for c in ("mom", "rev", "vol", "dd")])
    return E.family_composite(z, {"trend": (["mom", "rev"], 0.6), "risk": (["vol", "dd"], 0.4)}, ["dd"]).select("code", "month", *r6("composite", "coverage"), "eligible")


@q("fac_screener_score", f"""WITH {RAW}, {MEMBERS}, e AS (SELECT code, trade_date, close AS v, CASE WHEN count(ret) OVER r60 >= 60 AND stddev_samp(ret) OVER r60 > 0 THEN avg(ret) OVER r60 / stddev_samp(ret) OVER r60 END AS ram, row_number() OVER w AS n, lag(close, 20) OVER w AS back, avg(close) OVER r20 AS ma20, avg(close) OVER r60 AS ma60
  FROM rets WINDOW w AS (PARTITION BY code ORDER BY trade_date), r20 AS (PARTITION BY code ORDER BY trade_date ROWS 19 PRECEDING), r60 AS (PARTITION BY code ORDER BY trade_date ROWS 59 PRECEDING)),
 t AS (SELECT code, CAST(date_trunc('month', trade_date) AS DATE) AS month, arg_max(CASE WHEN n >= 20 THEN (sign(v - ma20) + CASE WHEN n >= 60 THEN sign(ma20 - ma60) ELSE 0 END + coalesce(sign(v - back), 0)) / (1.0 + (n >= 60)::INT + (back IS NOT NULL)::INT) END, trade_date) FILTER (WHERE true) AS trend0, max(trade_date) AS last FROM e GROUP BY 1, 2),
 u AS (SELECT t.code, t.month, e.ram, CASE WHEN e.n >= 20 THEN (sign(v - ma20) + CASE WHEN e.n >= 60 THEN sign(ma20 - ma60) ELSE 0 END + coalesce(sign(v - back), 0)) / (1.0 + (e.n >= 60)::INT + (back IS NOT NULL)::INT) END AS trend FROM t JOIN e ON e.code = t.code AND e.trade_date = t.last),
 ix AS (SELECT market AS code, trade_date, avg(close) AS close FROM bars JOIN members USING (code) GROUP BY 1, 2), iy AS (SELECT code, trade_date, close AS v, avg(close) OVER (PARTITION BY code ORDER BY trade_date ROWS 19 PRECEDING) AS a, avg(close) OVER (PARTITION BY code ORDER BY trade_date ROWS 59 PRECEDING) AS b, close / lag(close, 20) OVER w - 1 AS mom, row_number() OVER w AS n FROM ix WINDOW w AS (PARTITION BY code ORDER BY trade_date)),
 rg AS (SELECT code AS market, CAST(date_trunc('month', trade_date) AS DATE) AS month, arg_max(CASE WHEN n < 61 THEN 'insufficient' WHEN v > a AND a > b AND mom > 0 THEN 'risk_on' WHEN v < a AND a < b AND mom < 0 THEN 'risk_off' ELSE 'neutral' END, trade_date) AS regime FROM iy GROUP BY 1, 2),
 z AS (SELECT r.code, r.month, mb.market, regime, trend, round(0.45 * coalesce((mom - avg(mom) OVER m) / nullif(stddev_pop(mom) OVER m, 0), 0) + 0.35 * coalesce((ram - avg(ram) OVER m) / nullif(stddev_pop(ram) OVER m, 0), 0) + 0.2 * coalesce(trend, 0) + 0.5 * coalesce((dd - avg(dd) OVER m) / nullif(stddev_pop(dd) OVER m, 0), 0), 9) AS score
  FROM rawm r JOIN members mb USING (code) JOIN u ON u.code = r.code AND u.month = r.month JOIN rg ON rg.market = mb.market AND rg.month = r.month WINDOW m AS (PARTITION BY r.month)),
 y AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY month, market) >= 5 THEN (2.0 * (rank() OVER (PARTITION BY month, market ORDER BY score) - 1) + count(*) OVER (PARTITION BY month, market, score) - 1) / (2 * count(*) OVER (PARTITION BY month, market)) WHEN count(*) OVER (PARTITION BY month) >= 5 THEN (2.0 * (rank() OVER (PARTITION BY month ORDER BY score) - 1) + count(*) OVER (PARTITION BY month, score) - 1) / (2 * count(*) OVER (PARTITION BY month)) END AS q FROM z),
 k AS (SELECT *, CASE WHEN q IS NULL THEN 0 WHEN q >= 0.9 THEN CASE WHEN trend > 0 THEN 2 ELSE 1 END WHEN q >= 0.7 THEN 1 WHEN q < 0.1 THEN CASE WHEN trend < 0 THEN -2 ELSE -1 END WHEN q < 0.3 THEN -1 ELSE 0 END AS tier FROM y)
 SELECT code, month, regime, score, round(q, 6) AS q, CASE WHEN regime = 'risk_off' AND tier > 0 THEN tier - 1 ELSE tier END AS tier FROM k""".replace("arg_max(CASE WHEN n >= 20 THEN (sign(v - ma20) + CASE WHEN n >= 60 THEN sign(ma20 - ma60) ELSE 0 END + coalesce(sign(v - back), 0)) / (1.0 + (n >= 60)::INT + (back IS NOT NULL)::INT) END, trade_date) FILTER (WHERE true) AS trend0, ", ""))
def _(spark, d):
    """Momentum, risk-adjusted momentum, trend and drawdown of each month's end; a market's regime from the mean price of its members."""
    month = F.trunc("trade_date", "MM").alias("month")
    b, m = bars(spark, d), members(spark, d)
    index = b.join(m.select("code", "market"), "code").groupBy(F.col("market").alias("code"), "trade_date").agg(F.avg("close").alias("close"))
    regimes = S.regimes(index).groupBy(F.col("code").alias("market"), month).agg(F.max_by("regime", "trade_date").alias("regime"))
    x = month_panel(b).join(m.select("code", "market"), "code").join(regimes, ["market", "month"])
    return E.screen(x).select("code", "month", "regime", "score", *r6("q"), "tier")


YTD = """ytd AS (SELECT code, year, quarter, sum(v) OVER (PARTITION BY code, year ORDER BY quarter) AS v FROM (SELECT c_nationkey AS code, extract(year FROM o_orderdate) AS year, extract(quarter FROM o_orderdate) AS quarter, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3))"""


def ytd(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy(F.col("c_nationkey").alias("code"), F.year("o_orderdate").cast("long").alias("year"), F.quarter("o_orderdate").cast("long").alias("quarter")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    return g.select("code", "year", "quarter", F.sum("v").over(Window.partitionBy("code", "year").orderBy("quarter")).alias("v"))


@q("fac_ttm", f"WITH {YTD} SELECT a.code, a.year, a.quarter, round(CAST(CASE WHEN a.quarter = 4 THEN a.v ELSE a.v + f.v - s.v END AS DOUBLE), 2) AS ttm FROM ytd a LEFT JOIN ytd f ON f.code = a.code AND f.year = a.year - 1 AND f.quarter = 4 LEFT JOIN ytd s ON s.code = a.code AND s.year = a.year - 1 AND s.quarter = a.quarter")
def _(spark, d):
    return E.ttm(ytd(spark, d), "v").select("code", "year", "quarter", F.round(F.col("ttm").cast("double"), 2).alias("ttm"))


@q("fac_stability", f"WITH {YTD}, x AS (SELECT code, CAST(v AS DOUBLE) / 1e6 AS v, row_number() OVER (PARTITION BY code ORDER BY year * 10 + quarter DESC) - 1 AS k FROM ytd) SELECT code, round(CASE WHEN count(*) >= 3 THEN -stddev_samp(v) END, 6) AS stability, round(max(v) FILTER (WHERE k = 0) - avg(v) FILTER (WHERE k > 0), 6) AS change FROM x WHERE k < 8 GROUP BY code")
def _(spark, d):
    x = ytd(spark, d).select("code", (F.col("v").cast("double") / 1e6).alias("v"), (F.col("year") * 10 + F.col("quarter")).alias("at"))
    return E.stability(x, "v", "at").select("code", *r6("stability", "change"))


IC = f"""{FWD}, ranked AS (SELECT month, rank() OVER (PARTITION BY month ORDER BY score) + (count(*) OVER (PARTITION BY month, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY month ORDER BY fwd) + (count(*) OVER (PARTITION BY month, fwd) - 1) / 2.0 AS b FROM panel WHERE score IS NOT NULL AND fwd IS NOT NULL),
 ic AS (SELECT month, count(*) AS n, corr(a, b) AS ic FROM ranked GROUP BY month HAVING count(*) >= 5)"""


def ic(spark, d):
    return E.rank_ic(panel(spark, d))


@q("ev_rank_ic", f"WITH {IC} SELECT month, n, round(ic, 6) AS ic FROM ic")
def _(spark, d):
    return ic(spark, d).select("month", "n", *r6("ic"))


@q("ev_ic_summary", f"WITH {IC}, x AS (SELECT ic, lag(ic) OVER (ORDER BY month) AS prev FROM ic) SELECT count(ic) AS n, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std, round(avg(ic) / stddev_samp(ic), 6) AS ir, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 6) AS t, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit, round(corr(ic, prev), 6) AS decay FROM x")
def _(spark, d):
    return E.ic_summary(ic(spark, d)).select("n", *r6("mean", "std", "ir", "t", "hit", "decay"))


GAMMA = f"{IC}, s AS (SELECT row_number() OVER (ORDER BY month) AS i, ic AS v FROM ic WHERE ic IS NOT NULL), m AS (SELECT avg(v) AS m, count(*) AS n FROM s), g AS (SELECT k AS lag, sum((a.v - m) * (b.v - m)) / any_value(n) AS gamma, any_value(n) AS n, any_value(m) AS m FROM range(0, 13) r(k), s a, s b, m WHERE b.i = a.i - k GROUP BY k)"


def _ratio(pair, x: str) -> str:
    """SQL of two polynomials by Horner's rule."""
    top, bottom = (reduce(lambda out, t: f"({out} * {x} + {t:.17e})", terms[1:], f"{terms[0]:.17e}") for terms in pair)
    return f"({top} / {bottom})"


def cdf(z: str) -> str:
    x = f"(abs({z}) / sqrt(2e0))"
    large = f"(exp(-{x} * {x}) / {x} * (0.56418958354775628695e0 - {_ratio(E.ERFC_LARGE, f'(1e0 / ({x} * {x}))')} / ({x} * {x})))"
    upper = f"(CASE WHEN {x} <= 0.46875 THEN 1 - {x} * {_ratio(E.ERF_SMALL, f'({x} * {x})')} WHEN {x} <= 4 THEN exp(-{x} * {x}) * {_ratio(E.ERFC_MIDDLE, x)} ELSE {large} END / 2)"
    return f"(CASE WHEN {z} > 0 THEN 1 - {upper} ELSE {upper} END)"


@q("ev_newey_west", f"WITH {GAMMA}, x AS (SELECT max(n) AS n, max(m) AS mean, sum(gamma * CASE WHEN lag = 0 THEN 1.0 WHEN lag <= greatest(1, floor(pow(n, 0.25))) THEN 2 * (1 - lag / (greatest(1, floor(pow(n, 0.25))) + 1)) ELSE 0 END) AS lrv FROM g), y AS (SELECT *, mean / sqrt(lrv / n) AS t FROM x) SELECT n, round(mean, 6) AS mean, round(lrv, 6) AS lrv, round(t, 5) AS t, round(2 * (1 - {cdf('abs(t)')}), 5) AS p FROM y")
def _(spark, d):
    x = E.newey_west(ic(spark, d))
    return x.select("n", *r6("mean", "lrv"), F.round("t", 5).alias("t"), F.round("p", 5).alias("p"))


@q("ev_effective_n", f"WITH {GAMMA}, x AS (SELECT max(n) AS n, greatest(-0.99, least(0.99, max(gamma) FILTER (WHERE lag = 1) / max(gamma) FILTER (WHERE lag = 0))) AS rho FROM g) SELECT n, round(rho, 6) AS rho, round(greatest(1.0, least(n, n * (1 - rho) / (1 + rho))), 6) AS effective FROM x")
def _(spark, d):
    return E.effective_n(ic(spark, d)).select("n", *r6("rho", "effective"))


BOOT = f"""{IC}, s AS (SELECT row_number() OVER (ORDER BY month) AS i, ic AS v FROM ic WHERE ic IS NOT NULL), n AS (SELECT count(*) AS n FROM s),
 bl AS (SELECT r.r AS replicate, b.b, n, CAST('0x' || substring(md5('s,' || r.r || ',' || b.b), 1, 8) AS BIGINT) % n AS st FROM range(0, 500) r(r), range(0, 100) b(b), n WHERE b.b < ceil(n / 4.0)),
 means AS (SELECT replicate, avg(v) AS mean FROM bl, range(0, 4) k(k), s WHERE b * 4 + k.k < n AND s.i = (st + k.k) % n + 1 GROUP BY replicate)"""


@q("ev_block_bootstrap", f"WITH {BOOT}, o AS (SELECT mean, row_number() OVER (ORDER BY mean, replicate) - 1 AS k FROM means) SELECT round(max(mean) FILTER (WHERE k = 12), 6) AS lo, round(max(mean) FILTER (WHERE k = 486), 6) AS hi FROM o")
def _(spark, d):
    return E.bootstrap_ci(E.block_bootstrap(ic(spark, d), "ic", "month", 500, 4), 500).select(*r6("lo", "hi"))


@q("ev_fdr_bh", f"WITH {LAST}, p0 AS (SELECT code, 2 * (1 - {cdf('abs(beta)')}) AS p FROM b), r AS (SELECT code, p, row_number() OVER (ORDER BY p, code) AS rank, count(*) OVER () AS n FROM p0) SELECT code, round(p, 6) AS p, round(least(1.0, min(p * n / rank) OVER (ORDER BY rank DESC)), 6) AS q FROM r")
def _(spark, d):
    b = E.beta(proxied(spark, d)).select("code", (2 * (1 - E.normal_cdf(F.abs("beta")))).alias("p"))
    return E.fdr_bh(b, "p", "code").select("code", *r6("p", "q"))


def ppf(p: str) -> str:
    tail = lambda v: _ratio(E.PPF_TAIL, f"sqrt(-2 * ln({v}))")
    return f"(CASE WHEN {p} < {E.PPF_LOW} THEN {tail(p)} WHEN {p} <= {1 - E.PPF_LOW} THEN ({p} - 0.5) * {_ratio(E.PPF_MIDDLE, f'(({p} - 0.5e0) * ({p} - 0.5e0))')} ELSE -{tail(f'1 - {p}')} END)"


HURDLE = f"(0.4227843351 * {ppf('(1 - 1 / 10.0)')} + 0.5772156649 * {ppf('(1 - 1 / (10 * 2.718281828459045))')})"


@q("ev_sharpe_tests", f"""WITH {CLIP}, m AS (SELECT code, count(*) AS n, avg(ret) AS m, var_pop(ret) AS v, avg(ret) / stddev_samp(ret) AS sr FROM c GROUP BY 1),
 h AS (SELECT c.code, any_value(n) AS n, any_value(sr) AS sr, avg(pow(ret - m, 3)) / pow(any_value(v), 1.5) AS skew, avg(pow(ret - m, 4)) / pow(any_value(v), 2) - 3 AS kurt FROM c JOIN m USING (code) GROUP BY c.code),
 g AS (SELECT *, greatest(1 - skew * sr + (kurt + 2) / 4 * sr * sr, 1e-12) AS var FROM h), z AS (SELECT *, sr * sqrt(n - 1) / sqrt(var) AS z1, (sr - sqrt(var / (n - 1)) * {HURDLE}) * sqrt(n - 1) / sqrt(var) AS z2 FROM g)
 SELECT code, n, round(sr, 6) AS sr, round({cdf('z1')}, 6) AS psr, round({cdf('z2')}, 6) AS dsr, round(CASE WHEN sr > 0 THEN 1 + var * pow({ppf('0.95')} / sr, 2) END, 4) AS min_track FROM z""")
def _(spark, d):
    return E.sharpe_tests(clipped(spark, d), "code").select("code", "n", *r6("sr", "psr", "dsr"), F.round("min_track", 4).alias("min_track"))


@q("fn_norm_cdf_ppf", f"""WITH {BARS}, s AS (SELECT code, trade_date, count(volume) OVER d AS n, avg(volume) OVER d AS m, stddev_pop(volume) OVER d AS sd, volume FROM bars WINDOW d AS (PARTITION BY trade_date)),
 z AS (SELECT code, trade_date, CASE WHEN n < 2 OR sd = 0 THEN 0e0 ELSE (volume - m) / sd END AS z FROM s), c AS (SELECT *, {cdf('z')} AS cdf FROM z)
 SELECT code, trade_date, round(z, 6) AS z, round(cdf, 6) AS cdf, round({ppf('greatest(1e-9, least(1 - 1e-9, cdf))')}, 6) AS back FROM c""")
def _(spark, d):
    z = S.zscore(bars(spark, d), ["trade_date"], "volume").withColumn("cdf", E.normal_cdf(F.col("z")))
    return z.select("code", "trade_date", *r6("z", "cdf"), F.round(E.normal_ppf(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), "cdf"))), 6).alias("back"))


PERF = "perf AS (SELECT p_brand AS trial, CAST(extract(year FROM l_shipdate) % 6 AS INTEGER) AS period, avg(l_discount) AS performance FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def perf(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("p_brand").alias("trial"), (F.year("l_shipdate") % 6).alias("period")).agg(F.avg("l_discount").alias("performance"))


def half_splits(spark, periods: int):
    """All choices of half of the periods: a table of binomial size in the (constant) number of periods."""
    from itertools import combinations

    rows = [(s, p, p in c) for s, c in enumerate(combinations(range(periods), periods // 2)) for p in range(periods)]
    return spark.createDataFrame(rows, "split int, period int, inside boolean")


def _split_sql(periods: int) -> str:
    from itertools import combinations

    rows = [f"({s}, {p}, {str(p in c).lower()})" for s, c in enumerate(combinations(range(periods), periods // 2)) for p in range(periods)]
    return f"splits(split, period, inside) AS (VALUES {', '.join(rows)})"


PBO = f"""{PERF}, {_split_sql(6)}, m AS (SELECT split, trial, avg(performance) FILTER (WHERE inside) AS ins, avg(performance) FILTER (WHERE NOT inside) AS oos FROM perf JOIN splits USING (period) GROUP BY 1, 2),
 b AS (SELECT split, trial, ins AS bi, oos AS bo FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY round(ins, 12) DESC, trial DESC) AS k FROM m) WHERE k = 1),
 r AS (SELECT m.split, b.trial, any_value(bo - bi) AS degradation, least(1.0, (sum((round(oos, 12) < round(bo, 12))::INT) + 0.5 * (sum((round(oos, 12) = round(bo, 12))::INT) + 1)) / count(*)) AS rel_rank FROM m JOIN b ON m.split = b.split GROUP BY 1, 2),
 l AS (SELECT *, greatest(1e-9, least(1 - 1e-9, rel_rank)) AS c FROM r), pbo AS (SELECT split, trial, rel_rank, ln(c / (1 - c)) AS logit, rel_rank < 0.5 AS overfit, degradation FROM l)"""


def pbo(spark, d):
    p = perf(spark, d).withColumn("performance", F.round("performance", 12))
    return E.pbo(p, half_splits(spark, 6))


@q("ev_pbo", f"WITH {PBO} SELECT split, trial, round(rel_rank, 6) AS rel_rank, round(logit, 6) AS logit, overfit, round(degradation, 6) AS degradation FROM pbo")
def _(spark, d):
    return pbo(spark, d).select("split", "trial", *r6("rel_rank", "logit"), "overfit", *r6("degradation"))


@q("ev_pbo_summary", f"WITH {PBO} SELECT count(*) AS splits, round(avg(CAST(overfit AS INT)), 6) AS pbo, round(avg(degradation), 6) AS mean_degradation, round(list_sort(list(logit))[count(*) // 2 + 1], 6) AS median_logit FROM pbo")
def _(spark, d):
    return E.pbo_summary(pbo(spark, d)).select("splits", *r6("pbo", "mean_degradation", "median_logit"))


@q("ev_effective_trials", f"WITH {PERF}, c AS (SELECT a.trial AS a, b.trial AS b, corr(a.performance, b.performance) AS c FROM perf a JOIN perf b USING (period) WHERE a.trial <= b.trial GROUP BY 1, 2) SELECT sum((a = b)::INT) AS n, round(sum((a = b)::INT) * sum((a = b)::INT) / sum(CASE WHEN a = b THEN 1.0 ELSE 2 * c * c END), 6) AS effective FROM c")
def _(spark, d):
    return E.effective_trials(perf(spark, d), "trial", "period", "performance").select("n", *r6("effective"))


@q("agg_family_correlation", f"""WITH {RAW}, l AS (SELECT code, month, u.f, u.v FROM rawm, LATERAL (VALUES ('mom', mom), ('rev', rev), ('vol', vol), ('dd', dd)) u(f, v) WHERE u.v IS NOT NULL)
 SELECT a.f AS a, b.f AS b, round(CASE WHEN count(*) >= 3 THEN corr(a.v, b.v) END, 6) AS corr FROM l a JOIN l b USING (code, month) WHERE a.f <= b.f GROUP BY 1, 2""")
def _(spark, d):
    x = raw_panel(spark, d).unpivot(["code", "month"], ["mom", "rev", "vol", "dd"], "f", "v").withColumn("at", F.struct("code", "month"))
    return E.correlations(x, "f", "at", "v").select("a", "b", *r6("corr"))


@q("ev_active_alpha", f"WITH {PROXY} SELECT code, round(avg(ret - proxy), 6) AS active_mean, round(CASE WHEN stddev_samp(ret - proxy) > 0 THEN avg(ret - proxy) / stddev_samp(ret - proxy) * sqrt(252) END, 6) AS ir, round(regr_intercept(ret, proxy), 6) AS alpha, round(regr_slope(ret, proxy), 6) AS beta FROM p WHERE proxy IS NOT NULL GROUP BY code")
def _(spark, d):
    return E.active_alpha(proxied(spark, d).withColumnRenamed("proxy", "bench"), "code").select("code", *r6("active_mean", "ir", "alpha", "beta"))


@q("agg_information_ratio", f"WITH {PROXY} SELECT code, round(avg(ret - proxy) / nullif(stddev_samp(ret - proxy), 0) * sqrt(252), 6) AS information_ratio FROM p WHERE proxy IS NOT NULL GROUP BY code")
def _(spark, d):
    a = F.col("ret") - F.col("proxy")
    return proxied(spark, d).where("proxy is not null").groupBy("code").agg(F.round(F.avg(a) / F.nullif(F.stddev_samp(a), F.lit(0.0)) * F.sqrt(F.lit(252.0)), 6).alias("information_ratio"))


#: The mean of all others moves more than an index does, so its bound of high volatility is higher.
SLICES = f"""{PROXY}, sa AS (SELECT code, trade_date, ret, proxy, count(*) OVER v AS n, exp(sum(ln(greatest(1e-6, 1 + proxy))) OVER v) - 1 AS trend, stddev_samp(proxy) OVER v * sqrt(252.0) AS vol FROM p WHERE proxy IS NOT NULL WINDOW v AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
 sb AS (SELECT code, extract(year FROM trade_date) AS year, CASE WHEN n < 20 THEN 'warmup' WHEN vol >= 0.9 THEN 'high_volatility' WHEN trend >= 0.05 THEN 'bull' WHEN trend <= -0.05 THEN 'bear' ELSE 'sideways' END AS regime, ln(greatest(1e-6, 1 + ret - proxy)) AS a FROM sa),
 slices AS (SELECT code, year, regime, count(*) AS days, sum(a) AS log_active FROM sb GROUP BY GROUPING SETS ((code, year), (code, regime), (code)))"""


@q("ev_stability", f"WITH {SLICES} SELECT code, year, regime, days, round(log_active, 6) AS log_active FROM slices")
def _(spark, d):
    """Active return of each code by year and by the regime its benchmark was in before the day."""
    return E.stability_slices(proxied(spark, d), high_vol=0.9).withColumn("log_active", F.round("log_active", 6))


@q("ev_stability_gate", f"""WITH {SLICES}, g AS (SELECT code, min(exp(log_active) - 1) FILTER (WHERE year IS NOT NULL) AS worst_year, min(exp(log_active) - 1) FILTER (WHERE regime IS NOT NULL AND regime <> 'warmup' AND days >= 20) AS worst_regime,
  max(log_active) FILTER (WHERE year IS NULL AND regime IS NULL) AS t, max(log_active) FILTER (WHERE year IS NOT NULL) AS best, count(year) AS years FROM slices GROUP BY 1)
 SELECT code, round(worst_year, 6) AS worst_year, round(worst_regime, 6) AS worst_regime, round(CASE WHEN years > 1 THEN exp(t - best) - 1 END, 6) AS without_best, coalesce(worst_year >= -0.05 AND worst_regime >= -0.05 AND CASE WHEN years > 1 THEN exp(t - best) - 1 END > 0, false) AS passed FROM g""")
def _(spark, d):
    return E.stability_gate(E.stability_slices(proxied(spark, d), high_vol=0.9)).select("code", *r6("worst_year", "worst_regime", "without_best"), "passed")


@q("ev_folds", f"""WITH {BARS}, x AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM bars)),
 k AS (SELECT f.f AS fold, 500 + 5 + f.f * 110 AS v0 FROM range(0, 100) f(f), (SELECT max(n) AS n FROM x) WHERE 505 + f.f * 110 + 100 <= n), s AS (SELECT fold, 'train' AS role, 0 AS a, v0 - 6 AS b FROM k UNION ALL SELECT fold, 'validation', v0, v0 + 99 FROM k)
 SELECT CAST(fold AS INTEGER) AS fold, role, min(trade_date) AS first_day, max(trade_date) AS last_day FROM s JOIN x ON x.i BETWEEN a AND b GROUP BY 1, 2""")
def _(spark, d):
    return E.folds(bars(spark, d), 500, 100, 5, 10)


@q("ev_psi_drift", f"""WITH {BARS}, base AS (SELECT code, volume AS v FROM bars WHERE trade_date < DATE '1998-01-01'), cur AS (SELECT code, volume AS v FROM bars WHERE trade_date >= DATE '1998-01-01'),
 o AS (SELECT code, v, row_number() OVER (PARTITION BY code ORDER BY v) AS k, count(*) OVER (PARTITION BY code) AS n FROM base), bd AS (SELECT DISTINCT code, b, v AS bound FROM o, range(1, 10) r(b) WHERE k = n * b // 10),
 cb AS (SELECT base.code, v, base.rowid0 FROM (SELECT *, row_number() OVER () AS rowid0 FROM base) base), b1 AS (SELECT code, bin, count(*) AS c FROM (SELECT x.code, x.rowid0, count(bound) AS bin FROM cb x LEFT JOIN bd ON bd.code = x.code AND bound < x.v GROUP BY 1, 2) GROUP BY 1, 2),
 cc AS (SELECT *, row_number() OVER () AS rowid0 FROM cur), c1 AS (SELECT code, bin, count(*) AS c FROM (SELECT x.code, x.rowid0, count(bound) AS bin FROM cc x LEFT JOIN bd ON bd.code = x.code AND bound < x.v GROUP BY 1, 2) GROUP BY 1, 2),
 j AS (SELECT coalesce(b1.code, c1.code) AS code, b1.c AS b, c1.c AS c FROM b1 FULL JOIN c1 ON b1.code = c1.code AND b1.bin = c1.bin), p AS (SELECT code, greatest(coalesce(b / sum(b) OVER (PARTITION BY code), 0), 1e-4) AS pb, greatest(coalesce(c / sum(c) OVER (PARTITION BY code), 0), 1e-4) AS pc FROM j)
 SELECT code, round(sum((pc - pb) * ln(pc / pb)), 6) AS psi FROM p GROUP BY code""")
def _(spark, d):
    b = bars(spark, d)
    return E.psi(b.where("trade_date < '1998-01-01'"), b.where("trade_date >= '1998-01-01'"), "volume", "code").select("code", *r6("psi"))


BRIN = """bi AS (SELECT n_name AS industry, sum(l_extendedprice) AS a, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = '{f}' GROUP BY 1), {n} AS (SELECT industry, a / sum(a) OVER () AS weight, v / a - 1 AS ret FROM bi)"""


def industry_book(spark, d, flag):
    j = table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    g = j.groupBy(F.col("n_name").alias("industry")).agg(F.sum("l_extendedprice").alias("a"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return g.select("industry", (F.col("a") / F.sum("a").over(Window.partitionBy(F.lit(1)))).alias("weight"), (F.col("v") / F.col("a") - 1).alias("ret"))


@q("ev_attribution_brinson", f"""WITH {BRIN.format(f='R', n='p')}, {BRIN.format(f='N', n='b').replace('bi', 'bj')}, t AS (SELECT sum(weight * ret) AS total FROM b)
 SELECT coalesce(p.industry, b.industry) AS industry, round((coalesce(p.weight, 0) - coalesce(b.weight, 0)) * (coalesce(b.ret, p.ret) - total), 8) AS allocation, round(coalesce(b.weight, 0) * (coalesce(p.ret, b.ret) - coalesce(b.ret, p.ret)), 8) AS selection,
  round((coalesce(p.weight, 0) - coalesce(b.weight, 0)) * (coalesce(p.ret, b.ret) - coalesce(b.ret, p.ret)), 8) AS interaction FROM p FULL JOIN b ON p.industry = b.industry, t""")
def _(spark, d):
    x = E.brinson(industry_book(spark, d, "R"), industry_book(spark, d, "N"))
    return x.select("industry", *[F.round(c, 8).alias(c) for c in ("allocation", "selection", "interaction")])


CONTRIB = "contrib AS (SELECT extract(year FROM l_shipdate) AS period, l_returnflag AS name, sum(l_discount * l_extendedprice) / 1e9 AS c FROM lineitem GROUP BY 1, 2)"


def contrib(spark, d):
    return table(spark, d, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("period"), F.col("l_returnflag").alias("name")).agg((F.sum(F.col("l_discount") * F.col("l_extendedprice")) / 1e9).alias("c"))


@q("ev_carino", f"WITH {CONTRIB}, r AS (SELECT period, sum(c) AS r FROM contrib GROUP BY 1), t AS (SELECT (exp(sum(ln(1 + r))) - 1) / sum(ln(1 + r)) AS s FROM r) SELECT name, round(sum(c * ln(1 + r) / r * s), 8) AS linked FROM contrib JOIN r USING (period), t GROUP BY name")
def _(spark, d):
    return E.carino(contrib(spark, d)).select("name", F.round("linked", 8).alias("linked"))


@q("risk_tail", f"""WITH {CLIP}, x AS (SELECT code, trade_date, ret, sum(ln(greatest(1 + ret, 1e-6))) OVER w AS path FROM c WINDOW w AS (PARTITION BY code ORDER BY trade_date)), y AS (SELECT *, path - greatest(0, max(path) OVER (PARTITION BY code ORDER BY trade_date)) AS dd FROM x),
 z AS (SELECT code, ret, dd, count(*) OVER (PARTITION BY code) AS n, row_number() OVER (PARTITION BY code ORDER BY ret, trade_date) AS a, row_number() OVER (PARTITION BY code ORDER BY dd, trade_date) AS b FROM y)
 SELECT code, round(-max(ret) FILTER (WHERE a = ceil(0.05 * n)), 6) AS var, round(-avg(ret) FILTER (WHERE a <= ceil(0.05 * n)), 6) AS cvar, round(-avg(dd) FILTER (WHERE b <= ceil(0.05 * n)), 6) AS cdar FROM z GROUP BY code""")
def _(spark, d):
    return E.tail_risk(clipped(spark, d), "code").select("code", *r6("var", "cvar", "cdar"))


@q("risk_stress", f"WITH {MEMBERS}, p AS (SELECT code, market, cap / sum(cap) OVER () AS weight FROM members), s(scenario, industry, shock) AS (VALUES ('crash', NULL, -0.3), ('asia', 'ASIA', -0.5), ('europe', 'EUROPE', -0.4)), x AS (SELECT scenario, code, weight * shock AS loss FROM p JOIN s ON s.industry IS NULL OR s.industry = p.market) SELECT scenario, round(sum(loss), 6) AS total, arg_min(code, (loss, code)) AS worst FROM x GROUP BY scenario")
def _(spark, d):
    m = members(spark, d)
    p = m.crossJoin(m.agg(F.sum("cap").alias("all"))).select("code", F.col("market").alias("industry"), (F.col("cap") / F.col("all")).alias("weight"))
    s = spark.createDataFrame([("crash", None, -0.3), ("asia", "ASIA", -0.5), ("europe", "EUROPE", -0.4)], "scenario string, industry string, shock double")
    return E.stress(p, s).select("scenario", *r6("total"), "worst")


MRET = f"{BARS}, mr AS (SELECT market, month, ln(sum(amount) / sum(volume)) AS lp FROM (SELECT b.*, market, CAST(date_trunc('month', trade_date) AS DATE) AS month FROM bars b JOIN members USING (code)) GROUP BY 1, 2), mret AS (SELECT market, month, lp - lag(lp) OVER (PARTITION BY market ORDER BY month) AS ret FROM mr)"


def market_returns(spark, d):
    x = bars(spark, d).join(members(spark, d), "code").groupBy("market", F.trunc("trade_date", "MM").alias("month")).agg(F.log(F.sum("amount") / F.sum("volume")).alias("lp"))
    return x.select("market", "month", (F.col("lp") - F.lag("lp").over(Window.partitionBy("market").orderBy("month"))).alias("ret"))


@q("risk_covariance", f"""WITH {MEMBERS}, {MRET}, ag AS (SELECT month, pow(0.94, row_number() OVER (ORDER BY month DESC) - 1) AS w FROM (SELECT DISTINCT month FROM mret)), x AS (SELECT * FROM mret JOIN ag USING (month) WHERE ret IS NOT NULL),
 m AS (SELECT market, sum(w * ret) / sum(w) AS m FROM x GROUP BY 1), c AS (SELECT market, month, w, ret - m AS d FROM x JOIN m USING (market))
 SELECT a.market AS a, b.market AS b, round(sum(a.w * a.d * b.d) / sum(a.w), 8) AS cov FROM c a JOIN c b USING (month) WHERE a.market <= b.market GROUP BY 1, 2""")
def _(spark, d):
    return E.ewma_covariance(market_returns(spark, d), "market", "month", "ret").select("a", "b", F.round("cov", 8).alias("cov"))


def _det(a: str, b: str, c: str) -> str:
    """Determinant of the normal equations with the three named columns (each a list of three sums)."""
    (a1, a2, a3), (b1, b2, b3), (c1, c2, c3) = (x.split() for x in (a, b, c))
    return f"({a1} * ({b2} * {c3} - {b3} * {c2}) - {b1} * ({a2} * {c3} - {a3} * {c2}) + {c1} * ({a2} * {b3} - {a3} * {b2}))"


NORMAL = ("s0 s1 s2", "s1 s11 s12", "s2 s12 s22")


@q("risk_factor_returns", f"""WITH {MEMBERS}, {FWD}, x AS (SELECT p.month, fwd AS y, ln(cap) AS a, score AS b, sqrt(cap) AS w FROM panel p JOIN members USING (code) WHERE fwd IS NOT NULL AND score IS NOT NULL),
 s AS (SELECT month, sum(w) AS s0, sum(w * a) AS s1, sum(w * b) AS s2, sum(w * a * a) AS s11, sum(w * a * b) AS s12, sum(w * b * b) AS s22, sum(w * y) AS y0, sum(w * a * y) AS y1, sum(w * b * y) AS y2 FROM x GROUP BY 1 HAVING count(*) >= 6),
 f AS (SELECT month, {_det('y0 y1 y2', NORMAL[1], NORMAL[2])} / {_det(*NORMAL)} AS f0, {_det(NORMAL[0], 'y0 y1 y2', NORMAL[2])} / {_det(*NORMAL)} AS f1, {_det(NORMAL[0], NORMAL[1], 'y0 y1 y2')} / {_det(*NORMAL)} AS f2 FROM s),
 v AS (SELECT month, any_value(f0) AS f0, any_value(f1) AS f1, any_value(f2) AS f2, var_pop(y - f0 - f1 * a - f2 * b) AS v FROM x JOIN f USING (month) GROUP BY 1)
 SELECT month, u.f AS factor, round(u.r, 5) AS factor_return, round(v, 5) AS specific_var FROM v, LATERAL (VALUES ('intercept', f0), ('log_cap', f1), ('score', f2)) u(f, r)""")
def _(spark, d):
    """Months with at least six names (twice the unknowns)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("month"))
    x = panel(spark, d).join(members(spark, d), "code").withColumn("log_cap", F.log("cap")).where("fwd is not null and score is not null").withColumn("names", n).where("names >= 6")
    return E.factor_returns(x, "month", "fwd", ["log_cap", "score"], "cap").select("month", "factor", F.round("factor_return", 5).alias("factor_return"), F.round("specific_var", 5).alias("specific_var"))


@q("risk_portfolio", f"""WITH {MEMBERS}, {MRET}, ag AS (SELECT month, pow(0.94, row_number() OVER (ORDER BY month DESC) - 1) AS w FROM (SELECT DISTINCT month FROM mret)), x AS (SELECT * FROM mret JOIN ag USING (month) WHERE ret IS NOT NULL),
 m AS (SELECT market, sum(w * ret) / sum(w) AS m FROM x GROUP BY 1), c AS (SELECT market, month, w, ret - m AS d FROM x JOIN m USING (market)), v AS (SELECT a.market AS a, b.market AS b, sum(a.w * a.d * b.d) / sum(a.w) AS cov FROM c a JOIN c b USING (month) GROUP BY 1, 2),
 p AS (SELECT market, sum(cap) / (SELECT sum(cap) FROM members) AS p, 1.0 / (SELECT count(DISTINCT market) FROM members) AS q FROM members GROUP BY 1),
 k AS (SELECT v.a AS market, any_value(pa.p) AS p, any_value(pa.p - pa.q) AS t, sum(v.cov * pb.p) AS mp, sum(v.cov * (pb.p - pb.q)) AS mt FROM v JOIN p pa ON pa.market = v.a JOIN p pb ON pb.market = v.b GROUP BY 1)
 SELECT market, round(p, 6) AS weight, round(sum(p * mp) OVER (), 8) AS variance, round(p * mp / sum(p * mp) OVER (), 6) AS contribution, round(sqrt(greatest(0, sum(t * mt) OVER ())), 6) AS tracking_error FROM k""")
def _(spark, d):
    """Markets weighted by their caps against equal weights."""
    m = members(spark, d)
    w = m.groupBy("market").agg(F.sum("cap").alias("cap")).crossJoin(m.agg(F.sum("cap").alias("all"), F.countDistinct("market").alias("n"))).select("market", (F.col("cap") / F.col("all")).alias("weight"), (1.0 / F.col("n")).alias("benchmark"))
    got = E.portfolio_risk(E.ewma_covariance(market_returns(spark, d), "market", "month", "ret"), w, "market")
    return got.select("market", *r6("weight"), F.round("variance", 8).alias("variance"), *r6("contribution", "tracking_error"))


@q("risk_liquidation", f"WITH {MEMBERS}, {BARS}, a AS (SELECT code, avg(amount) AS adv, max(trade_date) AS last FROM bars GROUP BY 1) SELECT code, last >= DATE '2001-10-20' AS tradable, round(cap / greatest(adv * 0.1, 1.0), 6) AS normal_days, round(CASE WHEN last >= DATE '2001-10-20' THEN cap / greatest(adv * 0.1 * 0.3, 1.0) END, 6) AS stress_days FROM members JOIN a USING (code)")
def _(spark, d):
    adv = bars(spark, d).groupBy("code").agg(F.avg("amount").alias("adv"), F.max("trade_date").alias("last"))
    x = members(spark, d).join(adv, "code").withColumn("tradable", F.col("last") >= "2001-10-20")
    return E.liquidation_days(x, "cap", "adv", "tradable").select("code", "tradable", *r6("normal_days", "stress_days"))


@q("risk_calibration", f"WITH {RET}, x AS (SELECT code, trade_date, stddev_samp(ret) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS pred, abs(ret) AS real FROM rets) SELECT code, count(*) AS n, round(avg(real / pred), 6) AS ratio, round(avg(real - pred), 6) AS bias FROM x WHERE pred > 0 GROUP BY code")
def _(spark, d):
    x = rets(spark, d).select("code", F.stddev_samp("ret").over(S.over().rowsBetween(-60, -1)).alias("pred"), F.abs("ret").alias("real")).where("pred > 0")
    return x.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("real") / F.col("pred")), 6).alias("ratio"), F.round(F.avg(F.col("real") - F.col("pred")), 6).alias("bias"))


BRIDGE = """x AS (SELECT o_custkey AS account, p_brand AS industry, n_regionkey AS market, p_size > 25 AS large, l_extendedprice AS gross, l_extendedprice / l_quantity / p_retailprice - 1 AS ret, l_extendedprice * l_tax AS fees, l_extendedprice * l_discount AS slippage,
  l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
 t AS (SELECT sum(gross * ret) / sum(gross) AS m FROM x), i AS (SELECT industry, sum(gross * ret) / sum(gross) AS i FROM x GROUP BY 1), s AS (SELECT large, sum(gross * ret) / sum(gross) AS s FROM x GROUP BY 1),
 a AS (SELECT account, any_value(m) AS market, sum(gross * (i - m)) / sum(gross) AS industry, sum(gross * (s - m)) / sum(gross) AS style, sum(gross * (ret - i - s + m)) / sum(gross) AS selection, sum(fees) / sum(gross) AS fees, sum(slippage) / sum(gross) AS slippage,
  sum(gross) AS gross, sum(gross * ret) AS gain FROM x JOIN i USING (industry) JOIN s USING (large), t GROUP BY 1),
 b AS (SELECT c_custkey AS account, greatest(c_acctbal, 0) AS cash FROM customer), y AS (SELECT a.*, cash / (gross + cash) AS cash_share, (gain - gross * fees - gross * slippage) / (gross + cash) AS total FROM a JOIN b USING (account))"""


@q("ev_account_bridge", f"""WITH {BRIDGE}, z AS (SELECT account, total, selection, industry, style, market, -cash_share * (market + industry + style + selection) AS cash_drag, -fees * (1 - cash_share) AS fees, -slippage * (1 - cash_share) AS slippage FROM y)
 SELECT account, round(total, 6) AS total, round(selection, 6) AS selection, round(industry, 6) AS industry, round(style, 6) AS style, round(market, 6) AS market, round(cash_drag, 6) + 0.0 AS cash_drag, round(fees, 6) AS fees, round(slippage, 6) AS slippage,
  round(total - selection - industry - style - market - cash_drag - fees - slippage, 6) + 0.0 AS residual, abs(total - selection - industry - style - market - cash_drag - fees - slippage) > 0.001 AS warning FROM z""")
def _(spark, d):
    t = lambda name: table(spark, d, name)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    x = j.select(F.col("o_custkey").alias("account"), F.col("p_brand").alias("industry"), (F.col("p_size") > 25).alias("large"), F.col("l_extendedprice").alias("gross"), (F.col("l_extendedprice") / F.col("l_quantity") / F.col("p_retailprice") - 1).alias("ret"), (F.col("l_extendedprice") * F.col("l_tax")).alias("fees"), (F.col("l_extendedprice") * F.col("l_discount")).alias("slippage"))
    cash = t("customer").select(F.col("c_custkey").alias("account"), F.greatest("c_acctbal", F.lit(0.0)).alias("cash"))
    b = E.account_bridge(x, cash, "account", "industry", "large")
    return b.select("account", *[(F.round(c, 6) + 0.0).alias(c) for c in ("total", "selection", "industry", "style", "market", "cash_drag", "fees", "slippage", "residual")], "warning")
