"""Queries of the time-series operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof as A
from tidemark.operators import series as S
from tidemark.plans.base import BARS, MEMBERS, REVISIONS, bars, members, r6, revisions, table

QUERIES: dict = {}
ORACLES: dict = {}
ROWW = "WINDOW w AS (PARTITION BY code ORDER BY trade_date)"
RET = f"{BARS}, rets AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM bars {ROWW})"
KEY = ("code", "trade_date")


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rets(spark, d):
    return S.daily_return(bars(spark, d))


@q("win_daily_return", f"WITH {RET} SELECT code, trade_date, round(ret, 6) AS ret FROM rets")
def _(spark, d):
    return rets(spark, d).select(*KEY, *r6("ret"))


@q("win_total_return_index", f"""WITH {BARS}, x AS (SELECT code, trade_date, close AS unit, close + sum(CASE WHEN extract(day FROM trade_date) = 15 THEN 0.01 * close ELSE 0 END) OVER (PARTITION BY code ORDER BY trade_date) AS total FROM bars),
 y AS (SELECT *, greatest(0, total - unit - lag(total - unit) OVER {ROWW[7:].split(' AS ')[1]}) AS rise, lag(unit) OVER {ROWW[7:].split(' AS ')[1]} AS prev, first_value(unit) OVER {ROWW[7:].split(' AS ')[1]} AS base FROM x)
 SELECT code, trade_date, round(exp(sum(ln(CASE WHEN prev IS NULL THEN 1 ELSE (unit + CASE WHEN rise > 5e-5 THEN rise ELSE 0 END) / prev END)) OVER (PARTITION BY code ORDER BY trade_date)), 6) AS growth FROM y""")
def _(spark, d):
    w = S.over().rowsBetween(Window.unboundedPreceding, 0)
    x = bars(spark, d).withColumn("total", F.col("close") + F.sum(F.when(F.dayofmonth("trade_date") == 15, 0.01 * F.col("close")).otherwise(0.0)).over(w))
    base = F.first("close").over(w)
    return S.total_return_index(x, "close", "total").select(*KEY, F.round(F.col("idx") / base, 6).alias("growth"))


@q("win_period_return", f"WITH {BARS} SELECT code, trade_date, round(close / lag(close, 20) OVER w - 1, 6) AS ret_n, round(lag(close, 5) OVER w / lag(close, 25) OVER w - 1, 6) AS ret_skip FROM bars {ROWW}")
def _(spark, d):
    x = S.period_return(S.period_return(bars(spark, d), 20), 20, out="ret_skip", skip=5)
    return x.select(*KEY, *r6("ret_n", "ret_skip"))


@q("win_calendar_return", f"""WITH {BARS}, e AS (SELECT code, max(trade_date) AS end_date FROM bars GROUP BY 1),
 s AS (SELECT code, end_date, max(trade_date) AS start_date FROM bars JOIN e USING (code) WHERE trade_date <= CAST(end_date - INTERVAL 3 MONTH AS DATE) GROUP BY 1, 2)
 SELECT s.code, end_date, start_date, round(b.close / a.close - 1, 6) AS ret FROM s JOIN bars a ON a.code = s.code AND a.trade_date = start_date JOIN bars b ON b.code = s.code AND b.trade_date = end_date""")
def _(spark, d):
    return S.calendar_return(bars(spark, d), 3).select("code", "end_date", "start_date", *r6("ret"))


@q("win_volatility", f"WITH {RET} SELECT code, trade_date, round(CASE WHEN count(ret) OVER v >= 20 THEN stddev_samp(ret) OVER v * sqrt(252) END, 6) AS vol FROM rets WINDOW v AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    return S.volatility(rets(spark, d), 20).select(*KEY, *r6("vol"))


@q("win_max_drawdown", f"WITH {BARS} SELECT code, round(min(dd), 6) AS max_drawdown FROM (SELECT code, close / max(close) OVER w - 1 AS dd FROM bars {ROWW}) GROUP BY code")
def _(spark, d):
    return S.max_drawdown(bars(spark, d)).select("code", *r6("max_drawdown"))


@q("win_sharpe", f"WITH {RET} SELECT code, round(CASE WHEN stddev_samp(ret) > 0 THEN (avg(ret) - 0.02 / 252) / stddev_samp(ret) * sqrt(252) END, 6) AS sharpe FROM rets GROUP BY code")
def _(spark, d):
    return S.sharpe(rets(spark, d)).select("code", *r6("sharpe"))


@q("win_sortino_calmar_cvar", f"""WITH {RET}, x AS (SELECT code, trade_date, ret, exp(sum(ln(1 + ret)) OVER w) AS path, row_number() OVER (PARTITION BY code ORDER BY ret, trade_date) AS rk, count(*) OVER (PARTITION BY code) AS n FROM rets WHERE ret IS NOT NULL {ROWW}),
 y AS (SELECT *, path / greatest(1, max(path) OVER w) - 1 AS dd FROM x {ROWW})
 SELECT code, round((avg(ret) - 0.02 / 252) / nullif(sqrt(avg(pow(least(ret - 0.02 / 252, 0), 2))), 0) * sqrt(252), 6) AS sortino,
  round((exp(sum(ln(1 + ret)) * 252 / count(*)) - 1) / nullif(abs(min(dd)), 0), 6) AS calmar, round(avg(ret) FILTER (WHERE rk <= greatest(1, floor(n * 0.05))), 6) AS cvar FROM y GROUP BY code""")
def _(spark, d):
    return S.downside(rets(spark, d)).select("code", *r6("sortino", "calmar", "cvar"))


@q("win_annualise", f"WITH {BARS}, t AS (SELECT code, max_by(close, trade_date) / min_by(close, trade_date) - 1 AS total, count(*) - 1 AS n FROM bars GROUP BY 1) SELECT code, round(CASE WHEN n = 0 THEN total WHEN total <= -1 THEN NULL ELSE pow(1 + total, 252.0 / n) - 1 END, 6) AS annual FROM t")
def _(spark, d):
    t = bars(spark, d).groupBy("code").agg((F.max_by("close", "trade_date") / F.min_by("close", "trade_date") - 1).alias("total"), (F.count(F.lit(1)) - 1).alias("n"))
    return t.select("code", F.round(S.annualise(F.col("total"), F.col("n")), 6).alias("annual"))


@q("win_win_rate", f"WITH {RET} SELECT code, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM rets WHERE ret IS NOT NULL GROUP BY code")
def _(spark, d):
    return S.win_rate(rets(spark, d)).select("code", *r6("win_rate"))


@q("win_sma", f"WITH {BARS} SELECT code, trade_date, round(CASE WHEN row_number() OVER w >= 20 THEN avg(close) OVER (PARTITION BY code ORDER BY trade_date ROWS 19 PRECEDING) END, 4) AS ma20 FROM bars {ROWW}")
def _(spark, d):
    return S.sma(bars(spark, d), 20).select(*KEY, F.round("ma20", 4).alias("ma20"))


NUMBERED = f"WITH RECURSIVE {BARS}, n AS (SELECT *, row_number() OVER w AS i FROM bars {ROWW})"


@q("win_ema_macd", f"""{NUMBERED}, f AS (SELECT code, i, trade_date, close AS f, close AS g, CAST(0 AS DOUBLE) AS dea FROM n WHERE i = 1
 UNION ALL SELECT n.code, n.i, n.trade_date, 2.0 / 13 * n.close + (1 - 2.0 / 13) * f.f, 2.0 / 27 * n.close + (1 - 2.0 / 27) * f.g,
  2.0 / 10 * ((2.0 / 13 * n.close + (1 - 2.0 / 13) * f.f) - (2.0 / 27 * n.close + (1 - 2.0 / 27) * f.g)) + (1 - 2.0 / 10) * f.dea FROM f JOIN n ON n.code = f.code AND n.i = f.i + 1)
 SELECT code, trade_date, round(f - g, 4) AS dif, round(dea, 4) AS dea, round(2 * (f - g - dea), 4) AS hist FROM f""")
def _(spark, d):
    return S.macd(bars(spark, d)).select(*KEY, *[F.round(c, 4).alias(c) for c in ("dif", "dea", "hist")])


@q("win_rsi_wilder", f"""WITH RECURSIVE {BARS}, m AS (SELECT code, trade_date, close - lag(close) OVER w AS d FROM bars {ROWW}), n AS (SELECT *, row_number() OVER w AS i FROM m WHERE d IS NOT NULL {ROWW}),
 s AS (SELECT code, 14 AS i, max(trade_date) AS trade_date, sum(greatest(d, 0)) / 14 AS up, sum(greatest(-d, 0)) / 14 AS down FROM n WHERE i <= 14 GROUP BY code HAVING count(*) = 14),
 f AS (SELECT code, CAST(i AS BIGINT) AS i, trade_date, up, down FROM s UNION ALL SELECT n.code, n.i, n.trade_date, (f.up * 13 + greatest(d, 0)) / 14, (f.down * 13 + greatest(-d, 0)) / 14 FROM f JOIN n ON n.code = f.code AND n.i = f.i + 1)
 SELECT code, trade_date, round(CASE WHEN down = 0 THEN CASE WHEN up = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + up / down) END, 4) AS rsi FROM f""")
def _(spark, d):
    return S.rsi(bars(spark, d)).select(*KEY, F.round("rsi", 4).alias("rsi"))


@q("win_kdj", f"""WITH RECURSIVE {BARS}, r AS (SELECT code, trade_date, row_number() OVER w AS n, close, max(high) OVER (PARTITION BY code ORDER BY trade_date ROWS 8 PRECEDING) AS hi, min(low) OVER (PARTITION BY code ORDER BY trade_date ROWS 8 PRECEDING) AS lo FROM bars {ROWW}),
 x AS (SELECT code, trade_date, n - 8 AS i, CASE WHEN hi > lo THEN (close - lo) / (hi - lo) * 100 ELSE 50.0 END AS rsv FROM r WHERE n >= 9),
 f AS (SELECT code, i, trade_date, (100 + rsv) / 3 AS k, (100 + (100 + rsv) / 3) / 3 AS d FROM x WHERE i = 1
  UNION ALL SELECT x.code, x.i, x.trade_date, (2 * f.k + rsv) / 3, (2 * f.d + (2 * f.k + rsv) / 3) / 3 FROM f JOIN x ON x.code = f.code AND x.i = f.i + 1)
 SELECT code, trade_date, round(k, 4) AS k, round(d, 4) AS d, round(3 * k - 2 * d, 4) AS j FROM f""")
def _(spark, d):
    return S.kdj(bars(spark, d)).select(*KEY, *[F.round(c, 4).alias(c) for c in ("k", "d", "j")])


@q("win_bollinger_atr", f"""WITH {BARS}, x AS (SELECT *, coalesce(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), high - low) AS tr, row_number() OVER w AS n FROM bars {ROWW}),
 y AS (SELECT *, lag(close) OVER w AS prev FROM x {ROWW})
 SELECT code, trade_date, round(CASE WHEN n >= 20 THEN avg(close) OVER a END, 4) AS mid, round(CASE WHEN n >= 20 THEN avg(close) OVER a + 2 * stddev_pop(close) OVER a END, 4) AS upper,
  round(CASE WHEN n >= 20 THEN avg(close) OVER a - 2 * stddev_pop(close) OVER a END, 4) AS lower,
  round(CASE WHEN n >= 15 THEN avg(CASE WHEN prev IS NULL THEN high - low ELSE tr END) OVER (PARTITION BY code ORDER BY trade_date ROWS 13 PRECEDING) END, 4) AS atr,
  round(CASE WHEN n >= 20 THEN ln(min(low) OVER a) END, 6) AS support, round(CASE WHEN n >= 20 THEN ln(max(high) OVER a) END, 6) AS resistance,
  round(CASE WHEN n >= 25 THEN avg(volume) OVER (PARTITION BY code ORDER BY trade_date ROWS 4 PRECEDING) / avg(volume) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING) END, 4) AS volume_ratio
 FROM y WINDOW a AS (PARTITION BY code ORDER BY trade_date ROWS 19 PRECEDING)""")
def _(spark, d):
    x = S.bollinger_atr(bars(spark, d)).withColumns({"support": F.log("support"), "resistance": F.log("resistance")})
    return x.select(*KEY, *[F.round(c, 6 if c in ("support", "resistance") else 4).alias(c) for c in x.columns[2:]])


@q("win_trend_strength", f"""WITH {BARS}, x AS (SELECT code, trade_date, close AS v, row_number() OVER w AS n, lag(close, 20) OVER w AS back,
  avg(close) OVER (PARTITION BY code ORDER BY trade_date ROWS 19 PRECEDING) AS ma20, avg(close) OVER (PARTITION BY code ORDER BY trade_date ROWS 59 PRECEDING) AS ma60 FROM bars {ROWW}),
 y AS (SELECT code, trade_date, n, sign(v - ma20) AS a, CASE WHEN n >= 60 THEN sign(ma20 - ma60) END AS b, sign(v - back) AS c FROM x)
 SELECT code, trade_date, round(CASE WHEN n >= 20 THEN (a + coalesce(b, 0) + coalesce(c, 0)) / (1.0 + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT) END, 6) AS strength FROM y""")
def _(spark, d):
    return S.trend_strength(bars(spark, d)).select(*KEY, *r6("strength"))


@q("win_momentum_12_1", f"WITH {BARS} SELECT code, trade_date, round(lag(close, 21) OVER w / lag(close, 252) OVER w - 1, 6) AS mom FROM bars {ROWW}")
def _(spark, d):
    return S.momentum_12_1(bars(spark, d)).select(*KEY, *r6("mom"))


@q("win_momentum_blend", f"""WITH {BARS}, x AS (SELECT code, trade_date, close / lag(close, 20) OVER w - 1 AS a, close / lag(close, 60) OVER w - 1 AS b, close / lag(close, 120) OVER w - 1 AS c FROM bars {ROWW})
 SELECT code, trade_date, round(CASE WHEN a IS NOT NULL THEN (0.5 * a + coalesce(0.3 * b, 0) + coalesce(0.2 * c, 0)) / (0.5 + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END) END, 6) AS blend FROM x""")
def _(spark, d):
    return S.momentum_blend(bars(spark, d)).select(*KEY, *r6("blend"))


@q("win_risk_adj_momentum", f"WITH {RET} SELECT code, trade_date, round(CASE WHEN count(ret) OVER v >= 60 AND stddev_samp(ret) OVER v > 0 THEN avg(ret) OVER v / stddev_samp(ret) OVER v END, 6) AS ram FROM rets WINDOW v AS (PARTITION BY code ORDER BY trade_date ROWS 59 PRECEDING)")
def _(spark, d):
    return S.risk_adjusted_momentum(rets(spark, d)).select(*KEY, *r6("ram"))


@q("win_ewma_vol", f"""WITH {RET}, x AS (SELECT code, ret, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) - 1 AS k FROM rets WHERE ret IS NOT NULL),
 v AS (SELECT code, sqrt(252 * (pow(0.94, count(*)) * var_pop(ret) + sum(0.06 * pow(0.94, k) * ret * ret))) AS vol FROM x WHERE k < 60 GROUP BY code)
 SELECT code, round(vol, 6) AS vol, round(CASE WHEN vol > 0 THEN least(1.0, 0.15 / vol) END, 6) AS scalar, vol > 0.30 AS freeze FROM v""")
def _(spark, d):
    return S.ewma_volatility(rets(spark, d)).select("code", *r6("vol", "scalar"), "freeze")


@q("win_index_regime", f"""WITH {BARS}, x AS (SELECT code, trade_date, close AS v, avg(close) OVER (PARTITION BY code ORDER BY trade_date ROWS 19 PRECEDING) AS a, avg(close) OVER (PARTITION BY code ORDER BY trade_date ROWS 59 PRECEDING) AS b,
  close / lag(close, 20) OVER w - 1 AS mom, count(*) OVER (PARTITION BY code) AS n, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS k FROM bars {ROWW})
 SELECT code, trade_date, CASE WHEN n < 61 THEN 'insufficient' WHEN v > a AND a > b AND mom > 0 THEN 'risk_on' WHEN v < a AND a < b AND mom < 0 THEN 'risk_off' ELSE 'neutral' END AS regime FROM x WHERE k = 1""")
def _(spark, d):
    return S.regime(bars(spark, d))


@q("win_exante_regime", f"""WITH {RET}, x AS (SELECT code, trade_date, count(ret) OVER v AS n, exp(sum(ln(1 + ret)) OVER v) - 1 AS total, stddev_samp(ret) OVER v * sqrt(252) AS vol FROM rets WHERE ret IS NOT NULL WINDOW v AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
 SELECT code, trade_date, CASE WHEN n < 60 THEN 'warmup' WHEN vol > 2.0 THEN 'high_vol' WHEN total > 0.05 THEN 'bull' WHEN total < -0.05 THEN 'bear' ELSE 'sideways' END AS regime FROM x""")
def _(spark, d):
    return S.exante_regime(rets(spark, d), high_vol=2.0)


@q("win_two_state_filter", f"""WITH RECURSIVE {RET}, n AS (SELECT code, trade_date, least(ret, 1.0) AS ret, row_number() OVER w AS i FROM rets WHERE ret IS NOT NULL {ROWW}),
 l AS (SELECT code, trade_date, i, exp(-0.5 * ret * ret / (0.6 * 0.6)) / 0.6 AS hi, exp(-0.5 * ret * ret / (0.2 * 0.2)) / 0.2 AS lo FROM n),
 f AS (SELECT code, i, trade_date, 0.5 * hi / (0.5 * hi + 0.5 * lo) AS p FROM l WHERE i = 1 UNION ALL
  SELECT l.code, l.i, l.trade_date, (0.95 * f.p + 0.05 * (1 - f.p)) * hi / ((0.95 * f.p + 0.05 * (1 - f.p)) * hi + (1 - (0.95 * f.p + 0.05 * (1 - f.p))) * lo) FROM f JOIN l ON l.code = f.code AND l.i = f.i + 1)
 SELECT code, trade_date, round(p, 6) AS stress FROM f""")
def _(spark, d):
    return S.two_state_filter(rets(spark, d).where("ret is not null").withColumn("ret", F.least("ret", F.lit(1.0)))).select(*KEY, *r6("stress"))


SIGNAL = "sig AS (SELECT DISTINCT max(trade_date) AS signal_date FROM bars GROUP BY date_trunc('month', trade_date))"


def signals(spark, d):
    b = bars(spark, d)
    return b.groupBy(F.trunc("trade_date", "MM").alias("m")).agg(F.max("trade_date").alias("signal_date")).select("signal_date")


@q("win_forward_return", f"""WITH {BARS}, {SIGNAL}, p AS (SELECT c.code, signal_date FROM (SELECT DISTINCT code FROM bars) c, sig),
 a AS (SELECT p.code, p.signal_date, b.close FROM p ASOF LEFT JOIN bars b ON p.code = b.code AND p.signal_date >= b.trade_date)
 SELECT code, signal_date, round(lead(close) OVER (PARTITION BY code ORDER BY signal_date) / close - 1, 6) AS fwd FROM a""")
def _(spark, d):
    return S.forward_return(bars(spark, d), signals(spark, d)).select("code", "signal_date", *r6("fwd"))


@q("win_adv_prior", f"WITH {BARS} SELECT code, trade_date, round(CASE WHEN count(*) OVER v >= 5 THEN avg(volume) OVER v END, 6) AS adv FROM bars WHERE volume > 0 WINDOW v AS (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    return S.prior_volume(bars(spark, d)).select(*KEY, *r6("adv"))


FACTOR = "fac AS (SELECT code, trade_date, (high + low) / 2 AS open, high, low, close, CASE WHEN code % 7 = 0 AND extract(day FROM trade_date) = 3 THEN NULL ELSE 1 + 0.01 * (extract(year FROM trade_date) - 1994) END AS factor FROM bars)"


def factors(spark, d):
    f = F.when((F.col("code") % 7 == 0) & (F.dayofmonth("trade_date") == 3), F.lit(None)).otherwise(1 + 0.01 * (F.year("trade_date") - 1994))
    return bars(spark, d).select(*KEY, ((F.col("high") + F.col("low")) / 2).alias("open"), "high", "low", "close", f.alias("factor"))


@q("win_ca_adjust", f"""WITH {BARS}, {FACTOR}, ok AS (SELECT code, max_by(factor, trade_date) AS latest FROM fac GROUP BY code HAVING count(*) = count(factor))
 SELECT code, trade_date, {", ".join(f"round({c} * factor / latest, 4) AS {c}" for c in ("open", "high", "low", "close"))} FROM fac JOIN ok USING (code)""")
def _(spark, d):
    return S.adjust_forward(factors(spark, d)).select(*KEY, *[F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")])


@q("win_chain_extend", f"""WITH {BARS}, x AS (SELECT code, trade_date, close, CASE WHEN trade_date <= DATE '1999-12-31' THEN close * 0.5 END AS adjusted FROM bars),
 l AS (SELECT code, max_by(adjusted, trade_date) AS a, max_by(close, trade_date) AS c FROM x WHERE adjusted IS NOT NULL GROUP BY code)
 SELECT code, trade_date, round(ln(coalesce(adjusted, a * close / c)), 6) AS chained FROM x LEFT JOIN l USING (code)""")
def _(spark, d):
    x = bars(spark, d).withColumn("adjusted", F.when(F.col("trade_date") <= "1999-12-31", F.col("close") * 0.5))
    return S.chain_extend(x).select(*KEY, F.round(F.log("chained"), 6).alias("chained"))


@q("win_align_union_ffill", f"""WITH {BARS}, s AS (SELECT max(s) AS start FROM (SELECT code, min(trade_date) AS s FROM bars GROUP BY code)),
 g AS (SELECT c.code, t.trade_date FROM (SELECT DISTINCT code FROM bars) c, (SELECT DISTINCT trade_date FROM bars, s WHERE trade_date >= start) t)
 SELECT g.code, g.trade_date, round(ln(b.close), 6) AS close FROM g ASOF LEFT JOIN bars b ON g.code = b.code AND g.trade_date >= b.trade_date""")
def _(spark, d):
    return S.align_union(bars(spark, d)).select(*KEY, F.round(F.log("close"), 6).alias("close"))


@q("win_align_intersect", """WITH m AS (SELECT l_partkey AS code, l_returnflag || l_linestatus AS market, CAST(date_trunc('year', l_shipdate) AS DATE) AS trade_date FROM lineitem GROUP BY 1, 2, 3)
 SELECT market, trade_date FROM m GROUP BY 1, 2 HAVING count(DISTINCT code) = (SELECT count(DISTINCT code) FROM m x WHERE x.market = m.market)
 UNION ALL SELECT market, trade_date FROM (SELECT s_nationkey % 5 || '' AS market, l_suppkey AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3) y GROUP BY 1, 2
 HAVING count(DISTINCT code) = (SELECT count(DISTINCT l_suppkey) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey % 5 || '' = y.market)""")
def _(spark, d):
    """The years shared by all parts of a market, and the months shared by all suppliers of one: every series takes part."""
    lines = table(spark, d, "lineitem")
    parts = lines.select(F.col("l_partkey").alias("code"), F.concat("l_returnflag", "l_linestatus").alias("market"), F.trunc("l_shipdate", "YYYY").alias("trade_date")).distinct()
    months = lines.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_suppkey").alias("code"), (F.col("s_nationkey") % 5).cast("string").alias("market"), F.trunc("l_shipdate", "MM").alias("trade_date")).distinct()
    return S.align_intersect(parts, "market").unionByName(S.align_intersect(months, "market"))


@q("win_gap_detect", f"WITH {BARS}, x AS (SELECT code, trade_date, CAST(date_diff('day', lag(trade_date) OVER w, trade_date) AS INTEGER) AS gap FROM bars {ROWW}) SELECT * FROM x WHERE gap > 7 ORDER BY gap DESC, code, trade_date LIMIT 20")
def _(spark, d):
    return S.gaps(bars(spark, d), 7)


@q("win_latest_version", f"WITH {REVISIONS} SELECT code, effective_date, source, value FROM (SELECT *, row_number() OVER (PARTITION BY code, effective_date ORDER BY available_at DESC, ingest_no DESC) AS n FROM revisions) WHERE n = 1")
def _(spark, d):
    return S.latest_version(revisions(spark, d), ["code", "effective_date"], ["available_at", "ingest_no"]).select("code", "effective_date", "source", "value")


@q("win_month_ends", f"""WITH {BARS}, x AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM bars)), e AS (SELECT CAST(date_trunc('month', trade_date) AS DATE) AS month, max(i) AS i FROM x GROUP BY 1)
 SELECT e.month, x.trade_date FROM e JOIN x ON x.i = e.i - 2""")
def _(spark, d):
    return S.month_ends(bars(spark, d), -2)


@q("win_next_prev_trade_day", f"WITH {BARS} SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS prev_day, lead(trade_date) OVER (ORDER BY trade_date) AS next_day FROM (SELECT DISTINCT trade_date FROM bars)")
def _(spark, d):
    return S.realign_days(bars(spark, d))


MONTH = "monthly AS (SELECT code, CAST(date_trunc('month', trade_date) AS DATE) AS month, max_by(close, trade_date) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)"


def monthly(spark, d):
    return bars(spark, d).groupBy("code", F.trunc("trade_date", "MM").alias("month")).agg(F.max_by("close", "trade_date").alias("close"), F.sum("volume").alias("volume"))


QRANK = "CASE WHEN x IS NOT NULL THEN (2.0 * (rank() OVER (PARTITION BY month, x IS NULL ORDER BY x) - 1) + count(*) OVER (PARTITION BY month, x) - 1) / (2 * count(*) OVER (PARTITION BY month, x IS NULL)) END"


@q("win_quantile_rank", f"WITH {BARS}, {MONTH}, v AS (SELECT code, month, CASE WHEN code % 11 <> 0 THEN volume END AS x FROM monthly) SELECT code, month, round({QRANK}, 6) AS q FROM v")
def _(spark, d):
    x = monthly(spark, d).withColumn("x", F.when(F.col("code") % 11 != 0, F.col("volume")))
    return S.quantile_rank(x, ["month"], "x").select("code", "month", *r6("q"))


@q("win_hist_percentile", f"""WITH {BARS}, x AS (SELECT code, volume, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS k FROM bars), n AS (SELECT code, volume AS now FROM x WHERE k = 1)
 SELECT code, now, round(CASE WHEN count(*) >= 24 THEN (sum((volume < now)::INT) + sum((volume = now)::INT) / 2.0) / count(*) END, 6) AS pct FROM x JOIN n USING (code) WHERE k > 1 GROUP BY code, now""")
def _(spark, d):
    return S.historical_percentile(bars(spark, d), "volume").select("code", "now", *r6("pct"))


@q("win_zscore", f"WITH {BARS}, {MONTH} SELECT code, month, round(CASE WHEN count(close) OVER m < 2 OR stddev_pop(close) OVER m = 0 THEN 0 ELSE (close - avg(close) OVER m) / stddev_pop(close) OVER m END, 6) AS z FROM monthly WINDOW m AS (PARTITION BY month)")
def _(spark, d):
    return S.zscore(monthly(spark, d), ["month"], "close").select("code", "month", *r6("z"))


@q("win_winsorize", f"""WITH {BARS}, {MONTH}, c AS (SELECT month, quantile_cont(close, 0.01) AS lo, quantile_cont(close, 0.99) AS hi, count(close) AS n FROM monthly GROUP BY month)
 SELECT code, month, round(ln(CASE WHEN n >= 8 THEN greatest(lo, least(hi, close)) ELSE close END), 6) AS clipped FROM monthly JOIN c USING (month)""")
def _(spark, d):
    return S.winsorize(monthly(spark, d), ["month"], "close").select("code", "month", F.round(F.log("clipped"), 6).alias("clipped"))


@q("win_rank_avg", f"WITH {BARS}, {MONTH} SELECT code, month, rank() OVER (PARTITION BY month ORDER BY volume) + (count(*) OVER (PARTITION BY month, volume) - 1) / 2.0 AS rank FROM monthly")
def _(spark, d):
    return monthly(spark, d).select("code", "month", S.rank_avg(["month"], "volume").alias("rank"))


FWD = f"""{BARS}, {MONTH}, panel AS (SELECT code, month, close, volume, close / lag(close) OVER m - 1 AS score, lead(close) OVER m / close - 1 AS fwd FROM monthly WINDOW m AS (PARTITION BY code ORDER BY month))"""


def panel(spark, d):
    """Monthly scores (the month's return) with the next month's return."""
    w = Window.partitionBy("code").orderBy("month")
    m = monthly(spark, d)
    return m.select("code", "month", "close", "volume", (F.col("close") / F.lag("close").over(w) - 1).alias("score"), (F.lead("close").over(w) / F.col("close") - 1).alias("fwd"))


@q("win_quintile_a", f"""WITH {FWD}, x AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY month ORDER BY score, code) - 1) * 5 / count(*) OVER (PARTITION BY month)) AS INTEGER) AS bucket, count(*) OVER (PARTITION BY month) AS n FROM panel WHERE score IS NOT NULL AND fwd IS NOT NULL),
 g AS (SELECT month, least(bucket, 4) AS bucket, avg(fwd) AS mean FROM x WHERE n >= 10 GROUP BY 1, 2),
 e AS (SELECT a.month, sum(CASE WHEN b.bucket > a.bucket THEN sign(b.mean - a.mean) ELSE 0 END) * 2 / 20.0 AS tau, max(b.mean - a.mean) FILTER (WHERE a.bucket = 0 AND b.bucket = 4) AS spread, count(*) FILTER (WHERE b.bucket = a.bucket + 1 AND b.mean > a.mean) = 4 AS monotonic FROM g a JOIN g b USING (month) GROUP BY 1)
 SELECT month, bucket, round(mean, 6) AS mean, round(spread, 6) AS spread, round(tau, 6) AS kendall_tau, monotonic FROM g JOIN e USING (month)""")
def _(spark, d):
    g = S.quintile_a(panel(spark, d))
    return g.join(S.quintile_monotonicity(g), "month").select("month", "bucket", *r6("mean", "spread", "kendall_tau"), "monotonic")


@q("win_quintile_b", f"""WITH {FWD}, x AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score, code) - 1 AS p, count(*) OVER (PARTITION BY month) AS n FROM panel WHERE score IS NOT NULL AND fwd IS NOT NULL),
 y AS (SELECT *, (p >= n * 1 // 5)::INT + (p >= n * 2 // 5)::INT + (p >= n * 3 // 5)::INT + (p >= n * 4 // 5)::INT AS bucket FROM x WHERE n >= 10),
 g AS (SELECT month, bucket, avg(fwd) AS mean, count(*) AS n FROM y GROUP BY 1, 2), ms AS (SELECT month, lag(month) OVER (ORDER BY month) AS prev FROM (SELECT DISTINCT month FROM y)),
 o AS (SELECT a.month, a.bucket, count(*) AS kept FROM y a JOIN ms USING (month) JOIN y b ON b.month = ms.prev AND b.bucket = a.bucket AND b.code = a.code GROUP BY 1, 2),
 q AS (SELECT g.month, g.bucket, mean, CASE WHEN ms.prev IS NULL THEN 1.0 ELSE 1 - coalesce(kept, 0) / n END AS turnover FROM g JOIN ms USING (month) LEFT JOIN o ON o.month = g.month AND o.bucket = g.bucket), w AS (SELECT *, mean - 0.002 * turnover AS net FROM q),
 e AS (SELECT month, max(net) FILTER (WHERE bucket = 4) - max(net) FILTER (WHERE bucket = 0) AS spread, corr(net, bucket) AS monotone FROM w GROUP BY 1), h AS (SELECT *, avg(CASE WHEN spread > 0 THEN 1.0 ELSE 0 END) OVER (ORDER BY month) AS hit_rate FROM e)
 SELECT month, bucket, round(mean, 6) AS mean, round(turnover, 6) AS turnover, round(net, 6) AS net, round(spread, 6) AS spread, round(monotone, 6) AS monotone, round(hit_rate, 6) AS hit_rate FROM w JOIN h USING (month)""")
def _(spark, d):
    """Costs are paid both ways: twice the one-way rate of 0.1 %."""
    n = F.count(F.lit(1)).over(Window.partitionBy("month"))
    enough = panel(spark, d).where("score is not null and fwd is not null").withColumn("names", n).where("names >= 10").drop("names")
    g = S.quintile_b(enough, 0.002)
    return g.join(S.quintile_evidence(g), "month").select("month", "bucket", *r6("mean", "turnover", "net", "spread", "monotone", "hit_rate"))


@q("win_rank_turnover", f"""WITH {FWD}, ms AS (SELECT month, lag(month) OVER (ORDER BY month) AS prev FROM (SELECT DISTINCT month FROM panel WHERE score IS NOT NULL)),
 c AS (SELECT a.month, a.code, a.score AS s1, b.score AS s0 FROM panel a JOIN ms USING (month) JOIN panel b ON b.month = ms.prev AND b.code = a.code WHERE a.score IS NOT NULL AND b.score IS NOT NULL),
 r AS (SELECT month, rank() OVER (PARTITION BY month ORDER BY s1) AS r1, rank() OVER (PARTITION BY month ORDER BY s0) AS r0, count(*) OVER (PARTITION BY month) AS n FROM c)
 SELECT month, round(avg(abs(r1 - r0) * 1.0 / (n - 1)), 6) AS turnover FROM r WHERE n > 1 GROUP BY month""")
def _(spark, d):
    return S.rank_turnover(panel(spark, d)).select("month", *r6("turnover"))


@q("win_cusum", f"""WITH RECURSIVE {RET}, n AS (SELECT code, trade_date, ret, row_number() OVER w AS i FROM rets WHERE ret IS NOT NULL {ROWW}), m AS (SELECT code, median(ret) AS med FROM n GROUP BY 1),
 s AS (SELECT n.code, any_value(med) AS med, median(abs(ret - med)) * 1.4826 AS mad FROM n JOIN m USING (code) GROUP BY 1), z AS (SELECT n.code, i, CASE WHEN mad > 0 THEN (ret - med) / mad ELSE 0 END AS z FROM n JOIN s USING (code)),
 f AS (SELECT code, i, greatest(0.0, z - 0.5) AS up, greatest(0.0, -z - 0.5) AS down FROM z WHERE i = 1 UNION ALL SELECT z.code, z.i, greatest(0.0, f.up + z.z - 0.5), greatest(0.0, f.down - z.z - 0.5) FROM f JOIN z ON z.code = f.code AND z.i = f.i + 1)
 SELECT code, round(max(greatest(up, down)), 4) AS peak, max(greatest(up, down)) >= 5 AS alarm FROM f GROUP BY code""")
def _(spark, d):
    return S.cusum(rets(spark, d)).select("code", F.round("peak", 4).alias("peak"), "alarm")


@q("win_streak_monitor", f"""WITH {FWD}, ic AS (SELECT month, corr(score, fwd) AS ic FROM panel WHERE score IS NOT NULL AND fwd IS NOT NULL GROUP BY month HAVING count(*) >= 5),
 x AS (SELECT month, ic, row_number() OVER (ORDER BY month) AS i, avg(ic) OVER (ORDER BY month ROWS 5 PRECEDING) AS m6 FROM ic), y AS (SELECT *, i - coalesce(max(CASE WHEN ic >= 0 THEN i END) OVER (ORDER BY month), 0) AS streak FROM x)
 SELECT month, CAST(streak AS BIGINT) AS streak, round(m6, 6) AS mean6, CASE WHEN streak >= 6 OR (i >= 6 AND m6 < -0.02) THEN 'pause' WHEN streak >= 3 OR (i >= 6 AND m6 < 0) THEN 'downweight' ELSE 'keep' END AS action FROM y""")
def _(spark, d):
    ic = panel(spark, d).where("score is not null and fwd is not null").groupBy("month").agg(F.corr("score", "fwd").alias("ic"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    return S.streak_monitor(ic.select("month", "ic")).select("month", "streak", *r6("mean6"), "action")


@q("win_open_lots", """WITH t AS (SELECT o_custkey AS code, CAST(l_shipdate AS DATE) AS d, l_orderkey AS k, l_linenumber AS ln, l_extendedprice AS p, l_quantity AS q, l_returnflag = 'R' AS sell FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 s AS (SELECT code, sum(q) AS sold FROM t WHERE sell GROUP BY code), b AS (SELECT code, d, k, ln, q, sum(q) OVER (PARTITION BY code ORDER BY d, k, ln, p, q ROWS UNBOUNDED PRECEDING) AS cum FROM t WHERE NOT sell)
 SELECT code, d AS acquired, round(sum(least(q, greatest(0, cum - coalesce(sold, 0)))), 2) AS remaining FROM b LEFT JOIN s USING (code) WHERE cum > coalesce(sold, 0) GROUP BY 1, 2""")
def _(spark, d):
    t = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("code"), F.to_date("l_shipdate").alias("acquired"), "l_orderkey", "l_linenumber", "l_extendedprice", F.col("l_quantity").alias("qty"), (F.col("l_returnflag") == "R").alias("sell"))
    lots = S.open_lots(t, ["acquired", "l_orderkey", "l_linenumber", "l_extendedprice", "qty"])
    return lots.groupBy("code", "acquired").agg(F.round(F.sum("remaining"), 2).alias("remaining"))


@q("win_dca_buyhold", f"""WITH {BARS}, n AS (SELECT code, trade_date, close, row_number() OVER w - 1 AS i, first_value(close) OVER w AS base FROM bars {ROWW})
 SELECT code, trade_date, round(close / base, 6) AS hold, round(close * sum(CASE WHEN i % 20 = 0 THEN 100 / close ELSE 0 END) OVER w, 4) AS dca, round(sum(CASE WHEN i % 20 = 0 THEN 100.0 ELSE 0.0 END) OVER w, 2) AS paid FROM n {ROWW}""")
def _(spark, d):
    return S.dca(bars(spark, d), 20, 100.0).select(*KEY, F.round("hold", 6).alias("hold"), F.round("dca", 4).alias("dca"), F.round("paid", 2).alias("paid"))


@q("win_apply_costs", f"WITH {RET} SELECT code, trade_date, round(CASE WHEN extract(day FROM trade_date) <= 3 THEN (1 + ret) * (1 - 0.0015) - 1 ELSE ret END, 6) AS net FROM rets")
def _(spark, d):
    x = rets(spark, d)
    trades = x.where(F.dayofmonth("trade_date") <= 3).select(*KEY)
    return S.apply_costs(x, trades, 0.0015).select(*KEY, *r6("net"))


@q("win_index_benchmark", f"""WITH {BARS}, ix AS (SELECT trade_date, sum(amount) / sum(volume) AS close FROM bars GROUP BY 1), cal AS (SELECT DISTINCT trade_date FROM bars),
 f AS (SELECT c.trade_date, i.close FROM cal c ASOF LEFT JOIN ix i ON c.trade_date >= i.trade_date), b AS (SELECT min_by(close, trade_date) AS base FROM f WHERE trade_date >= DATE '1996-01-01')
 SELECT trade_date, round(CASE WHEN trade_date < DATE '1996-01-01' THEN 1.0 ELSE close / base END, 6) AS curve FROM f, b""")
def _(spark, d):
    b = bars(spark, d)
    ix = b.groupBy("trade_date").agg((F.sum("amount") / F.sum("volume")).alias("close"))
    return S.index_benchmark(b.select("trade_date").distinct(), ix, "1996-01-01").select("trade_date", *r6("curve"))


@q("win_daily_move", f"WITH {RET} SELECT code, trade_date, round(coalesce(CASE WHEN extract(day FROM trade_date) % 2 = 0 THEN 0.001 END, ret), 6) AS move FROM rets")
def _(spark, d):
    x = bars(spark, d).withColumn("raw_return", F.when(F.dayofmonth("trade_date") % 2 == 0, 0.001))
    return S.daily_move(x).select(*KEY, *r6("move"))


@q("win_refresh_pct", f"WITH {BARS}, x AS (SELECT code, trade_date, close / lag(close) OVER w - 1 AS pct FROM bars {ROWW}) SELECT code, trade_date, round(pct, 6) AS pct FROM x WHERE trade_date >= DATE '2000-01-01'")
def _(spark, d):
    b = bars(spark, d)
    return S.refresh_pct(b.where("trade_date < '2000-01-01'"), b.where("trade_date >= '2000-01-01'")).select(*KEY, *r6("pct"))


@q("win_cash_interest", "WITH b AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS trade_date, sum(o_totalprice) AS settled FROM orders GROUP BY 1, 2) SELECT code, trade_date, round(lag(settled) OVER (PARTITION BY code ORDER BY trade_date) * 0.0035 * date_diff('day', lag(trade_date) OVER (PARTITION BY code ORDER BY trade_date), trade_date) / 365, 4) AS interest FROM b")
def _(spark, d):
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("trade_date")).agg(F.sum("o_totalprice").alias("settled"))
    return S.cash_interest(b, 0.0035, 4)


@q("win_twr", f"""WITH {BARS}, x AS (SELECT code, trade_date, amount, volume, lag(amount) OVER w AS prev FROM bars {ROWW}), y AS (SELECT code, (amount - 10 * volume) / prev - 1 AS r FROM x WHERE prev > 0)
 SELECT code, round(sum(ln(greatest(1 + r, 1e-6))), 6) AS log_twr FROM y GROUP BY code""")
def _(spark, d):
    x = bars(spark, d).withColumn("flow", 10 * F.col("volume"))
    return S.twr(x, "amount", "flow").select("code", *r6("log_twr"))


MACD = """mf AS (SELECT code, i, trade_date, close AS f, close AS g, CAST(0 AS DOUBLE) AS dea FROM n WHERE i = 1 UNION ALL SELECT n.code, n.i, n.trade_date, 2.0 / 13 * n.close + (1 - 2.0 / 13) * mf.f, 2.0 / 27 * n.close + (1 - 2.0 / 27) * mf.g,
  2.0 / 10 * ((2.0 / 13 * n.close + (1 - 2.0 / 13) * mf.f) - (2.0 / 27 * n.close + (1 - 2.0 / 27) * mf.g)) + (1 - 2.0 / 10) * mf.dea FROM mf JOIN n ON n.code = mf.code AND n.i = mf.i + 1)"""


@q("win_cross_signals", f"""{NUMBERED}, {MACD}, x AS (SELECT code, trade_date, i, lead(trade_date) OVER w AS act, sign(avg(close) OVER (PARTITION BY code ORDER BY trade_date ROWS 4 PRECEDING) - avg(close) OVER (PARTITION BY code ORDER BY trade_date ROWS 19 PRECEDING)) AS s FROM n {ROWW}),
 z AS (SELECT 'ma' AS kind, code, trade_date, act, s FROM x WHERE i >= 20 UNION ALL SELECT 'macd', code, trade_date, lead(trade_date) OVER w, sign(f - g - dea) FROM mf {ROWW}), y AS (SELECT *, lag(s) OVER (PARTITION BY kind, code ORDER BY trade_date) AS p FROM z)
 SELECT kind, code, act AS trade_date, CASE WHEN s > 0 THEN 'golden' ELSE 'death' END AS cross_type FROM y WHERE act IS NOT NULL AND ((s > 0 AND p <= 0) OR (s < 0 AND p >= 0))""")
def _(spark, d):
    x = bars(spark, d)
    return S.crosses(x, 5, 20).withColumn("kind", F.lit("ma")).unionByName(S.macd_crosses(x).withColumn("kind", F.lit("macd")))


@q("win_fund_indicator_row", f"""{NUMBERED}, {MACD}, rets AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM bars {ROWW}), y AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS k, lag(close, 20) OVER w AS p20, lag(close, 60) OVER w AS p60, lag(close, 250) OVER w AS p250,
  avg(close) OVER (PARTITION BY code ORDER BY trade_date ROWS 19 PRECEDING) AS ma20, avg(close) OVER (PARTITION BY code ORDER BY trade_date ROWS 59 PRECEDING) AS ma60, close / max(close) OVER w - 1 AS dd FROM rets {ROWW}),
 a AS (SELECT code, stddev_samp(ret) * sqrt(252) AS vol, min(dd) AS mdd, CASE WHEN stddev_samp(ret) > 0 THEN (avg(ret) - 0.02 / 252) / stddev_samp(ret) * sqrt(252) END AS sharpe, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS wr FROM y GROUP BY code),
 o AS (SELECT code, max(trade_date) AS e FROM bars GROUP BY 1), r1 AS (SELECT code, max_by(close, trade_date) AS p FROM bars JOIN o USING (code) WHERE trade_date <= CAST(e - INTERVAL 12 MONTH AS DATE) GROUP BY 1),
 m AS (SELECT code, i, f - g AS dif, dea FROM mf QUALIFY row_number() OVER (PARTITION BY code ORDER BY i DESC) = 1),
 t AS (SELECT *, CASE WHEN close >= ma20 THEN 1 ELSE -1 END + CASE WHEN i < 60 THEN 0 WHEN ma20 >= ma60 THEN 1 ELSE -1 END + CASE WHEN dif > dea THEN 1 ELSE -1 END AS s FROM y JOIN m USING (code) WHERE k = 1)
 SELECT code, trade_date, round(close / p20 - 1, 6) AS r20, round(close / p60 - 1, 6) AS r60, round(close / p250 - 1, 6) AS r250, round(close / p - 1, 6) AS r1y, round(vol, 6) AS vol, round(mdd, 6) AS max_drawdown, round(sharpe, 6) AS sharpe, round(wr, 6) AS win_rate, round(ma20, 4) AS ma20, round(ma60, 4) AS ma60,
  round(dif, 4) AS dif, round(dea, 4) AS dea, round(2 * (dif - dea), 4) AS hist, CASE WHEN i < 20 THEN 'neutral' WHEN s >= 2 THEN 'strong_up' WHEN s = 1 THEN 'up' WHEN s = -1 THEN 'down' WHEN s <= -2 THEN 'strong_down' ELSE 'neutral' END AS signal FROM t JOIN a USING (code) LEFT JOIN r1 USING (code)""")
def _(spark, d):
    x = S.indicator_row(bars(spark, d))
    return x.select("code", "trade_date", *r6("r20", "r60", "r250", "r1y", "vol", "max_drawdown", "sharpe", "win_rate"), *[F.round(c, 4).alias(c) for c in ("ma20", "ma60", "dif", "dea", "hist")], "signal")


@q("win_technical_score", f"""{NUMBERED}, {MACD}, mv AS (SELECT code, trade_date, i - 1 AS i, close - lag(close) OVER w AS d FROM n WINDOW w AS (PARTITION BY code ORDER BY i)),
 rs AS (SELECT code, 12 AS i, max(trade_date) AS trade_date, sum(greatest(d, 0)) / 12 AS up, sum(greatest(-d, 0)) / 12 AS down FROM mv WHERE i BETWEEN 1 AND 12 GROUP BY code HAVING count(*) = 12),
 rf AS (SELECT code, CAST(i AS BIGINT) AS i, trade_date, up, down FROM rs UNION ALL SELECT mv.code, mv.i, mv.trade_date, (rf.up * 11 + greatest(d, 0)) / 12, (rf.down * 11 + greatest(-d, 0)) / 12 FROM rf JOIN mv ON mv.code = rf.code AND mv.i = rf.i + 1),
 hl AS (SELECT code, i, trade_date, close, max(high) OVER k AS hi, min(low) OVER k AS lo FROM n WINDOW k AS (PARTITION BY code ORDER BY i ROWS 8 PRECEDING)), rv AS (SELECT code, i, trade_date, CASE WHEN hi > lo THEN (close - lo) / (hi - lo) * 100 ELSE 50 END AS rsv FROM hl),
 kd AS (SELECT code, i, 50e0 * 2 / 3 + rsv / 3 AS k, 50e0 * 2 / 3 + (50e0 * 2 / 3 + rsv / 3) / 3 AS d FROM rv WHERE i = 1 UNION ALL SELECT rv.code, rv.i, kd.k * 2 / 3 + rsv / 3, kd.d * 2 / 3 + (kd.k * 2 / 3 + rsv / 3) / 3 FROM kd JOIN rv ON rv.code = kd.code AND rv.i = kd.i + 1),
 t AS (SELECT *, CASE WHEN i > 1 THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM n WINDOW w AS (PARTITION BY code ORDER BY i)),
 m AS (SELECT code, i, trade_date, close, avg(close) OVER (PARTITION BY code ORDER BY i ROWS 4 PRECEDING) AS ma5, avg(close) OVER b AS ma20, stddev_pop(close) OVER b AS sd, avg(tr) OVER (PARTITION BY code ORDER BY i ROWS 13 PRECEDING) / close AS atr,
  avg(volume) OVER (PARTITION BY code ORDER BY i ROWS 4 PRECEDING) / nullif(avg(volume) OVER (PARTITION BY code ORDER BY i ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING), 0) AS ratio FROM t WINDOW b AS (PARTITION BY code ORDER BY i ROWS 19 PRECEDING)),
 j AS (SELECT m.*, CASE WHEN rf.down = 0 THEN CASE WHEN rf.up = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + rf.up / rf.down) END AS rsi, CASE WHEN mf.f - mf.g > mf.dea THEN 1 ELSE -1 END AS macd, CASE WHEN kd.k > kd.d THEN 1 ELSE -1 END AS kdj
  FROM m JOIN mf ON mf.code = m.code AND mf.i = m.i JOIN kd ON kd.code = m.code AND kd.i = m.i LEFT JOIN rf ON rf.code = m.code AND rf.trade_date = m.trade_date),
 s AS (SELECT *, CASE WHEN i < 30 THEN 0 ELSE CASE WHEN close > ma20 THEN 1 ELSE -1 END + CASE WHEN ma5 > ma20 THEN 1 ELSE -1 END + macd + CASE WHEN rsi BETWEEN 50 AND 70 THEN 1 WHEN rsi < 40 THEN -1 ELSE 0 END + kdj END AS score FROM j)
 SELECT code, trade_date, score, CASE WHEN i < 30 THEN 'insufficient' WHEN score >= 4 THEN 'strong_bullish' WHEN score >= 2 THEN 'bullish' WHEN score <= -4 THEN 'strong_bearish' WHEN score <= -2 THEN 'bearish' ELSE 'neutral' END AS trend,
  CASE WHEN i < 30 THEN 'few_bars' ELSE concat_ws(',', CASE WHEN rsi > 70 THEN 'hot' WHEN rsi < 30 THEN 'weak' END, CASE WHEN close >= ma20 + 2 * sd THEN 'upper_band' WHEN close <= ma20 - 2 * sd THEN 'lower_band' END, CASE WHEN atr >= 0.05 THEN 'volatile' END, CASE WHEN ratio < 0.6 THEN 'thin_volume' END) END AS risks FROM s""")
def _(spark, d):
    return S.technical_score(bars(spark, d))


@q("win_time_decay", """WITH e AS (SELECT user_id AS code, event_id, CASE WHEN event_id % 3 = 0 THEN -value ELSE value END AS score, date_diff('second', ts, TIMESTAMP '2024-02-01') / 86400.0 AS age, 7 + 7 * (event_id % 3) AS horizon FROM events),
 d AS (SELECT code, event_id, score * pow(2, -age / greatest(2, horizon / 2.0)) AS s FROM e WHERE age >= 0 AND age <= horizon), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY abs(s) DESC, event_id) AS k FROM d)
 SELECT code, round(10 * tanh(least(80, greatest(-80, sum(s))) / 180), 6) AS score FROM r WHERE k <= 12 GROUP BY code""")
def _(spark, d):
    e = table(spark, d, "events")
    age = (F.unix_timestamp(F.lit("2024-02-01 00:00:00")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 86400.0
    score = F.when(F.col("event_id") % 3 == 0, -F.col("value")).otherwise(F.col("value"))
    x = e.select(F.col("user_id").alias("code"), "event_id", score.alias("score"), age.alias("age"), (7 + 7 * (F.col("event_id") % 3)).alias("horizon"))
    return S.time_decay(x).select("code", *r6("score"))
