"""Queries of joins, filters, aggregates, top-k and set operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof as A
from tidemark.operators import factors as FA
from tidemark.operators import keywords as K
from tidemark.operators import relational as R
from tidemark.operators import series as S
from tidemark.plans.base import BARS, FIGURES, MEMBERS, REVISIONS, VALUATIONS, bars, figures, members, r6, revisions, table, valuations
from tidemark.plans.evidence import RAW, raw_panel
from tidemark.plans.series import SIGNAL, signals
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


POSITIONS = "positions AS (SELECT o_custkey AS account, l_partkey AS fund, sum(l_quantity) AS shares, round(sum(l_extendedprice), 4) AS cost, round(sum(l_extendedprice * (1 - l_discount)), 4) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def positions(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.col("o_custkey").alias("account"), F.col("l_partkey").alias("fund")).agg(F.sum("l_quantity").alias("shares"), F.round(F.sum("l_extendedprice"), 4).alias("cost"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("value"))


@q("join_equi", f"WITH {POSITIONS} SELECT account, fund, p_name AS name, shares FROM positions JOIN part ON fund = p_partkey")
def _(spark, d):
    return positions(spark, d).join(table(spark, d, "part"), F.col("fund") == F.col("p_partkey")).select("account", "fund", F.col("p_name").alias("name"), "shares")


@q("join_left", "SELECT s_suppkey AS code, o.last_ship FROM supplier LEFT JOIN (SELECT l_suppkey, max(CAST(l_shipdate AS DATE)) AS last_ship FROM lineitem WHERE l_discount > 0.09 GROUP BY 1) o ON s_suppkey = l_suppkey")
def _(spark, d):
    last = table(spark, d, "lineitem").where("l_discount > 0.09").groupBy("l_suppkey").agg(F.max(F.to_date("l_shipdate")).alias("last_ship"))
    return table(spark, d, "supplier").join(last, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_suppkey").alias("code"), "last_ship")


@q("join_anti_pending", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return o.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@q("join_semi_wanted", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


PROBES = f"{BARS}, probes AS (SELECT s_suppkey AS code, m.signal_date AS at FROM supplier, (SELECT DISTINCT CAST(date_trunc('month', trade_date) AS DATE) AS signal_date FROM bars) m)"


def probes(spark, d):
    m = bars(spark, d).select(F.trunc("trade_date", "MM").alias("at")).distinct()
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("code")).crossJoin(F.broadcast(m))


@q("join_asof_back", f"WITH {PROBES} SELECT p.code, p.at, b.trade_date, b.volume FROM probes p ASOF LEFT JOIN bars b ON p.code = b.code AND p.at >= b.trade_date")
def _(spark, d):
    return A.asof_join(probes(spark, d), bars(spark, d), "code", "at", "trade_date", ["volume"])


@q("join_asof_strict", f"WITH {PROBES} SELECT p.code, p.at, b.trade_date, b.volume FROM probes p ASOF LEFT JOIN bars b ON p.code = b.code AND p.at > b.trade_date")
def _(spark, d):
    return A.asof_join(probes(spark, d), bars(spark, d), "code", "at", "trade_date", ["volume"], strict=True)


@q("join_asof_multi", f"WITH {PROBES} SELECT p.code, p.at, b.trade_date, b.volume FROM (SELECT q.code, q.at + 14 AS at FROM probes q UNION ALL SELECT q.code, q.at FROM probes q) p ASOF LEFT JOIN bars b ON p.code = b.code AND p.at >= b.trade_date")
def _(spark, d):
    p = probes(spark, d)
    return A.asof_join(p.select("code", F.date_add("at", 14).alias("at")).unionByName(p), bars(spark, d), "code", "at", "trade_date", ["volume"])


@q("join_asof_kth", f"WITH {PROBES}, n AS (SELECT code, trade_date, row_number() OVER (PARTITION BY code ORDER BY trade_date) AS i FROM bars), a AS (SELECT p.code, p.at, n.i FROM probes p ASOF LEFT JOIN n ON p.code = n.code AND p.at > n.trade_date) SELECT a.code, a.at, n.trade_date FROM a LEFT JOIN n ON n.code = a.code AND n.i = a.i - 1")
def _(spark, d):
    return A.kth_before(probes(spark, d), bars(spark, d), "code", "at", "trade_date", 2).select("code", "at", "trade_date")


SNAP = "snap AS (SELECT code, trade_date, CASE WHEN extract(day FROM trade_date) % 3 = 0 THEN volume END AS a, CASE WHEN extract(day FROM trade_date) % 5 = 0 THEN amount END AS b FROM bars)"


def snaps(spark, d):
    return bars(spark, d).select("code", "trade_date", F.when(F.dayofmonth("trade_date") % 3 == 0, F.col("volume")).alias("a"), F.when(F.dayofmonth("trade_date") % 5 == 0, F.col("amount")).alias("b"))


@q("join_asof_any_field", f"WITH {PROBES}, {SNAP} SELECT p.code, p.at, s.trade_date, s.a FROM probes p ASOF LEFT JOIN (SELECT * FROM snap WHERE a IS NOT NULL OR b IS NOT NULL) s ON p.code = s.code AND p.at >= s.trade_date")
def _(spark, d):
    return A.asof_join(probes(spark, d), snaps(spark, d), "code", "at", "trade_date", ["a", "b"], any_of=["a", "b"]).drop("b")


@q("join_asof_per_field", f"WITH {PROBES}, {SNAP} SELECT p.code, p.at, a.a, round(b.b, 2) AS b FROM probes p ASOF LEFT JOIN (SELECT * FROM snap WHERE a IS NOT NULL) a ON p.code = a.code AND p.at >= a.trade_date ASOF LEFT JOIN (SELECT * FROM snap WHERE b IS NOT NULL) b ON p.code = b.code AND p.at >= b.trade_date")
def _(spark, d):
    return A.asof_join(probes(spark, d), snaps(spark, d), "code", "at", "trade_date", ["a", "b"], per_field=True).select("code", "at", "a", F.round("b", 2).alias("b"))


IV = "iv AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS start_date, max(CASE WHEN o_orderkey % 11 = 0 THEN DATE '9999-12-31' ELSE CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 5 = 0 THEN 700 ELSE 60 END END) AS last_date FROM orders GROUP BY 1, 2)"


@q("join_interval", f"""WITH {IV}, ev AS (SELECT o_custkey AS code, DATE '1998-06-15' AS at FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, DATE '2000-03-01' FROM customer),
 r AS (SELECT e.code, e.at, arg_max(i, i.start_date) AS i FROM ev e JOIN iv i ON e.code = i.code AND e.at BETWEEN i.start_date AND i.last_date GROUP BY 1, 2)
 SELECT e.code, e.at, i.start_date, nullif(i.last_date, DATE '9999-12-31') AS end_date FROM ev e LEFT JOIN r ON e.code = r.code AND e.at = r.at""")
def _(spark, d):
    """Periods of two months, of two years (they hold shorter ones), and open ones."""
    o = table(spark, d, "orders")
    last = F.when(F.col("o_orderkey") % 11 == 0, F.lit("9999-12-31").cast("date")).otherwise(F.date_add(F.to_date("o_orderdate"), F.when(F.col("o_orderkey") % 5 == 0, 700).otherwise(60)))
    iv = o.groupBy(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("start_date")).agg(F.max(last).alias("last")).select("code", "start_date", F.nullif("last", F.lit("9999-12-31").cast("date")).alias("end_date"))
    ev = o.select(F.col("o_custkey").alias("code")).distinct().withColumn("at", F.lit("1998-06-15").cast("date")).unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.lit("2000-03-01").cast("date").alias("at")))
    return A.interval_join(ev, iv, "code", "at", "start_date", "end_date")


RULES = [("R", "1995-01-01", "1998-01-01", 0.003), ("R", "1998-01-01", None, 0.001), ("N", "1995-01-01", None, 0.0005), ("A", "1996-01-01", "1999-06-30", 0.002)]


@q("join_rule_version", "WITH rules(flag, f, t, rate) AS (VALUES ('R', DATE '1995-01-01', DATE '1998-01-01', 0.003), ('R', DATE '1998-01-01', NULL, 0.001), ('N', DATE '1995-01-01', NULL, 0.0005), ('A', DATE '1996-01-01', DATE '1999-06-30', 0.002)) SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(rate AS DOUBLE) AS rate FROM lineitem LEFT JOIN rules ON l_returnflag = flag AND CAST(l_shipdate AS DATE) >= f AND (t IS NULL OR CAST(l_shipdate AS DATE) < t)")
def _(spark, d):
    rules = spark.createDataFrame(RULES, "l_returnflag string, effective_from string, effective_to string, rate double").withColumns({c: F.col(c).cast("date") for c in ("effective_from", "effective_to")})
    x = table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return A.rule_join(x, rules, ["l_returnflag"], "day").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "rate")


@q("join_bitemporal", f"WITH {REVISIONS}, v AS (SELECT *, available_at AS system_from, lead(available_at) OVER (PARTITION BY code, effective_date ORDER BY available_at, ingest_no) AS system_to FROM revisions) SELECT code, effective_date, source, value FROM v WHERE effective_date <= DATE '1999-01-01' AND available_at <= DATE '1999-01-01' AND system_from <= DATE '1998-12-01' AND (system_to IS NULL OR system_to > DATE '1998-12-01')")
def _(spark, d):
    w = Window.partitionBy("code", "effective_date").orderBy("available_at", "ingest_no")
    v = revisions(spark, d).withColumn("system_from", F.col("available_at")).withColumn("system_to", F.lead("available_at").over(w))
    return A.bitemporal(v, "1999-01-01", "1998-12-01").select("code", "effective_date", "source", "value")


@q("flt_range_asof", f"WITH {REVISIONS} SELECT code, effective_date, value FROM (SELECT *, row_number() OVER (PARTITION BY code, effective_date ORDER BY available_at DESC, ingest_no DESC) AS n FROM revisions WHERE effective_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND available_at <= DATE '1997-06-30') WHERE n = 1")
def _(spark, d):
    x = revisions(spark, d).where("effective_date between '1996-01-01' and '1997-12-31' and available_at <= '1997-06-30'")
    return S.latest_version(x, ["code", "effective_date"], ["available_at", "ingest_no"]).select("code", "effective_date", "value")


@q("flt_latest_n", f"WITH {BARS} SELECT code, trade_date, volume FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS k FROM bars WHERE trade_date < DATE '2000-01-01') WHERE k <= 30")
def _(spark, d):
    return R.keep_last_n(bars(spark, d).where("trade_date < '2000-01-01'"), "code", "trade_date", 30).select("code", "trade_date", "volume")


@q("flt_catalog", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p_size < 5 THEN 'inactive' WHEN p_type LIKE 'SMALL%' THEN 'type' WHEN p_name LIKE '%1%' THEN 'keyword' END AS reason FROM part) GROUP BY 1")
def _(spark, d):
    rules = [("inactive", F.col("p_size") < 5), ("type", F.col("p_type").startswith("SMALL")), ("keyword", F.col("p_name").contains("1"))]
    return R.first_reason(table(spark, d, "part"), rules).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@q("flt_universe_reasons", f"WITH {BARS}, g AS (SELECT code, count(*) AS n, max(trade_date) AS last, avg(volume) FILTER (WHERE k <= 20) AS v20 FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS k FROM bars) GROUP BY 1) SELECT code, concat_ws(',', CASE WHEN code % 17 = 0 THEN 'st' END, CASE WHEN n < 520 THEN 'history' END, CASE WHEN last < DATE '2001-10-20' THEN 'suspended' END, CASE WHEN v20 < 28 THEN 'volume' END) AS reasons, NOT (code % 17 = 0 OR n < 520 OR last < DATE '2001-10-20' OR v20 < 28) AS passed FROM g")
def _(spark, d):
    x = bars(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("trade_date"))))
    g = x.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max("trade_date").alias("last"), F.avg(F.when(F.col("k") <= 20, F.col("volume"))).alias("v20"))
    rules = [("st", F.col("code") % 17 == 0), ("history", F.col("n") < 520), ("suspended", F.col("last") < "2001-10-20"), ("volume", F.col("v20") < 28)]
    return R.all_reasons(g, rules).select("code", F.array_join("reasons", ",").alias("reasons"), "passed")


@q("flt_tradability", f"""WITH {BARS}, x AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY trade_date) AS prev, CASE WHEN extract(day FROM trade_date) <> 13 THEN low END AS open FROM bars)
 SELECT code, trade_date, CASE WHEN volume < 5 THEN 'suspended' WHEN open IS NULL THEN 'no_open' WHEN prev IS NULL THEN 'no_reference' WHEN high = low AND high >= prev * 1.1 - 1e-4 THEN 'one_word_up' WHEN high = low AND low <= prev * 0.9 + 1e-4 THEN 'one_word_down' WHEN open >= prev * 1.1 - 1e-4 THEN 'limit_up' WHEN open <= prev * 0.9 + 1e-4 THEN 'limit_down' ELSE 'ok' END AS status,
  NOT (volume < 5 OR open IS NULL OR prev IS NULL OR open >= prev * 1.1 - 1e-4 OR high = low AND high >= prev * 1.1 - 1e-4) AS can_buy, NOT (volume < 5 OR open IS NULL OR prev IS NULL OR open <= prev * 0.9 + 1e-4 OR high = low AND low <= prev * 0.9 + 1e-4) AS can_sell FROM x""")
def _(spark, d):
    """The low stands for the open, which is missing on the 13th."""
    x = bars(spark, d).withColumns({"prev": F.lag("close").over(S.over()), "open": F.when(F.dayofmonth("trade_date") != 13, F.col("low"))})
    return R.tradability(x).select("code", "trade_date", "status", "can_buy", "can_sell")


@q("flt_signals_page", "SELECT event_id, value, rank, total FROM (SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) AS rank, count(*) OVER () AS total FROM events WHERE event_type = 'click') WHERE rank > 20 AND rank <= 40")
def _(spark, d):
    e = table(spark, d, "events").where("event_type = 'click'")
    return R.page(e.select("event_id", "value"), [F.desc("value"), F.asc("event_id")], 20, 20)


@q("flt_news_scope", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3', 'src7') ORDER BY doc_id DESC LIMIT 50")
def _(spark, d):
    held = F.array(*[F.lit(s) for s in ("src1", "src3", "src7")])
    return table(spark, d, "documents").where(F.arrays_overlap(F.split("source", ","), held)).orderBy(F.desc_nulls_last("doc_id")).limit(50).select("doc_id", "source")


@q("flt_pit_guard", f"WITH {REVISIONS} SELECT code, count(*) AS violations FROM revisions WHERE available_at IS NULL OR available_at > effective_date + 30 GROUP BY 1")
def _(spark, d):
    bad = revisions(spark, d).where(F.col("available_at").isNull() | (F.col("available_at") > F.date_add("effective_date", 30)))
    return bad.groupBy("code").agg(F.count(F.lit(1)).alias("violations"))


@q("flt_industry_coverage", "SELECT c_mktsegment AS pool, round(avg(CASE WHEN s_suppkey IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS ratio, avg(CASE WHEN s_suppkey IS NOT NULL THEN 1.0 ELSE 0.0 END) < 0.5 AS rejected FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey GROUP BY 1")
def _(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left")
    known = F.avg(F.when(F.col("s_suppkey").isNotNull(), 1.0).otherwise(0.0))
    return j.groupBy(F.col("c_mktsegment").alias("pool")).agg(F.round(known, 6).alias("ratio"), (known < 0.5).alias("rejected"))


@q("flt_sla_overdue", "SELECT event_type, max(ts) AS last_success, date_diff('minute', max(ts), TIMESTAMP '2024-01-31 00:00:00') > 60 AS overdue FROM events GROUP BY 1")
def _(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("last_success"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return g.withColumn("overdue", (F.floor(F.unix_timestamp(now.cast("timestamp")) / 60) - F.floor(F.unix_timestamp(F.col("last_success").cast("timestamp")) / 60)) > 60)


@q("flt_catalog_search", "SELECT p_partkey, p_name, count(*) OVER () AS total FROM part WHERE (contains(p_name, '7') OR contains(CAST(p_partkey AS VARCHAR), '7')) AND p_size > 10 ORDER BY p_partkey LIMIT 25")
def _(spark, d):
    p = table(spark, d, "part").where((F.col("p_name").contains("7") | F.col("p_partkey").cast("string").contains("7")) & (F.col("p_size") > 10))
    return R.page(p.select("p_partkey", "p_name"), [F.asc("p_partkey")], 25, 0).drop("rank")


@q("flt_transactions", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_extendedprice LIMIT 30 OFFSET 30")
def _(spark, d):
    x = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    return R.page(x, [F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_extendedprice")], 30, 30).select("l_orderkey", "l_linenumber", "l_extendedprice")


@q("flt_stock_list", "SELECT s_suppkey, s_name FROM supplier WHERE contains(s_name, '1') ORDER BY s_suppkey LIMIT 20")
def _(spark, d):
    return table(spark, d, "supplier").where(F.col("s_name").contains("1")).orderBy("s_suppkey").limit(20).select("s_suppkey", "s_name")


@q("flt_ready_members", f"WITH {BARS} SELECT code, count(*) AS samples FROM bars GROUP BY 1 HAVING count(*) >= 530 ORDER BY code LIMIT 40")
def _(spark, d):
    return bars(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("samples")).where("samples >= 530").orderBy("code").limit(40)


@q("flt_context_cut", f"WITH {BARS}, {SIGNAL} SELECT code, signal_date, count(*) AS bars FROM bars JOIN sig ON trade_date <= signal_date GROUP BY 1, 2")
def _(spark, d):
    w = Window.partitionBy("code").orderBy("trade_date")
    n = bars(spark, d).withColumn("bars", F.row_number().over(w).cast("long"))
    p = n.select("code").distinct().crossJoin(F.broadcast(signals(spark, d)))
    return A.asof_join(p, n, "code", "signal_date", "trade_date", ["bars"]).where("bars is not null").select("code", "signal_date", "bars")


@q("agg_positions", f"WITH {POSITIONS} SELECT fund, round(sum(cost), 4) AS cost, round(sum(value), 4) AS value, round((sum(value) - sum(cost)) / nullif(sum(cost), 0), 6) AS rate FROM positions GROUP BY 1")
def _(spark, d):
    g = positions(spark, d).groupBy("fund").agg(F.sum("cost").alias("c"), F.sum("value").alias("v"))
    return g.select("fund", F.round("c", 4).alias("cost"), F.round("v", 4).alias("value"), F.round((F.col("v") - F.col("c")) / F.nullif(F.col("c"), F.lit(0.0)), 6).alias("rate"))


@q("agg_portfolio_summary", f"WITH {POSITIONS} SELECT account, round(sum(coalesce(CASE WHEN fund % 9 = 0 THEN NULL ELSE value END, cost)), 4) AS total, count(*) AS funds FROM positions GROUP BY 1")
def _(spark, d):
    v = F.coalesce(F.when(F.col("fund") % 9 != 0, F.col("value")), "cost")
    return positions(spark, d).groupBy("account").agg(F.round(F.sum(v), 4).alias("total"), F.count(F.lit(1)).alias("funds"))


@q("agg_cashflow_year", "SELECT o_custkey AS account, extract(year FROM l_shipdate) AS year, round(sum(CASE WHEN l_returnflag = 'N' THEN -l_extendedprice ELSE l_extendedprice END), 2) AS flow FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def _(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    signed = F.when(F.col("l_returnflag") == "N", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return j.groupBy(F.col("o_custkey").alias("account"), F.year("l_shipdate").cast("long").alias("year")).agg(F.round(F.sum(signed), 2).alias("flow"))


@q("agg_net_invested", "SELECT l_partkey AS fund, round(greatest(sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE -l_extendedprice END), 0), 2) AS net FROM lineitem GROUP BY 1")
def _(spark, d):
    signed = F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice"))
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("fund")).agg(F.round(F.greatest(F.sum(signed), F.lit(0.0)), 2).alias("net"))


@q("agg_concentration", f"WITH {POSITIONS}, x AS (SELECT account, value / sum(value) OVER (PARTITION BY account) AS w, row_number() OVER (PARTITION BY account ORDER BY value DESC, fund) AS k FROM positions), g AS (SELECT account, max(w) AS top1, sum(CASE WHEN k <= 3 THEN w ELSE 0 END) AS top3, sum(w * w) AS hhi FROM x GROUP BY 1) SELECT account, round(top1, 6) AS top1, round(top3, 6) AS top3, round(hhi, 6) AS hhi, CASE WHEN top1 > 0.4 THEN 'high' WHEN top3 > 0.6 THEN 'medium' ELSE 'low' END AS level FROM g")
def _(spark, d):
    return R.concentration(positions(spark, d), "account", "fund", "value").select("account", *r6("top1", "top3", "hhi"), "level")


@q("agg_window_returns", f"WITH {BARS}, e AS (SELECT code, max(trade_date) AS e FROM bars GROUP BY 1), w AS (SELECT code, e, u.n AS win, u.s AS st FROM e, LATERAL (VALUES ('1d', e - 1), ('1w', e - 7), ('1m', CAST(e - INTERVAL 1 MONTH AS DATE)), ('3m', CAST(e - INTERVAL 3 MONTH AS DATE))) u(n, s)), a AS (SELECT w.*, b.close AS s0, b.trade_date AS at0 FROM w ASOF LEFT JOIN bars b ON w.code = b.code AND w.st >= b.trade_date), y AS (SELECT a.*, z.close AS s1 FROM a JOIN bars z ON z.code = a.code AND z.trade_date = a.e) SELECT win, count(s0) AS n, round(sum(s1 - s0) / sum(s0), 6) AS rate, round(coalesce(sum(s1) FILTER (WHERE s0 IS NOT NULL), 0) / sum(s1), 6) AS coverage, count(*) FILTER (WHERE s0 IS NULL) AS missing, count(*) FILTER (WHERE at0 < st - 10) AS stale, count(*) FILTER (WHERE at0 >= st - 10) AS ready FROM y GROUP BY win")
def _(spark, d):
    b = bars(spark, d)
    e = b.groupBy("code").agg(F.max("trade_date").alias("e"), F.max_by("close", "trade_date").alias("c1"))
    opts = F.array(*[F.struct(F.lit(n).alias("win"), x.alias("at")) for n, x in (("1d", F.date_sub("e", 1)), ("1w", F.date_sub("e", 7)), ("1m", F.add_months("e", -1)), ("3m", F.add_months("e", -3)))])
    p = e.withColumn("o", F.explode(opts)).select("code", "c1", "o.*")
    x = A.asof_join(p, b, "code", "at", "trade_date", ["close"])
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    old = F.col("trade_date") < F.date_sub("at", 10)
    return x.groupBy("win").agg(
        F.count("close").alias("n"), F.round(F.sum(F.col("c1") - F.col("close")) / F.sum("close"), 6).alias("rate"), F.round(F.coalesce(F.sum(F.when(F.col("close").isNotNull(), F.col("c1"))), F.lit(0.0)) / F.sum("c1"), 6).alias("coverage"),
        count(F.col("close").isNull()).alias("missing"), count(old).alias("stale"), count(~old).alias("ready"),
    )


@q("agg_dup_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return R.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@q("agg_null_keys", "SELECT 'documents' AS dataset, count(*) AS n FROM documents WHERE doc_id IS NULL OR text IS NULL UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id IS NULL OR toxic IS NULL UNION ALL SELECT 'events', count(*) FROM events WHERE event_id IS NULL OR ts IS NULL")
def _(spark, d):
    parts = [("documents", ["doc_id", "text"]), ("labels", ["doc_id", "toxic"]), ("events", ["event_id", "ts"])]
    out = None
    for t, cols in parts:
        bad = F.lit(False)
        for c in cols:
            bad = bad | F.col(c).isNull()
        x = table(spark, d, t).agg(F.count(F.when(bad, 1)).alias("n")).select(F.lit(t).alias("dataset"), "n")
        out = x if out is None else out.unionByName(x)
    return out


@q("agg_range_violations", "SELECT u.rule, u.n FROM (SELECT count(*) FILTER (WHERE l_discount > 0.08) AS discount, count(*) FILTER (WHERE l_extendedprice <= 0) AS price, count(*) FILTER (WHERE l_shipdate > TIMESTAMP '2001-10-01') AS future FROM lineitem) t, LATERAL (VALUES ('discount', discount), ('price', price), ('future', future)) u(rule, n)")
def _(spark, d):
    rules = [("discount", F.col("l_discount") > 0.08), ("price", F.col("l_extendedprice") <= 0), ("future", F.col("l_shipdate") > F.lit("2001-10-01").cast("timestamp_ntz"))]
    return R.violations(table(spark, d, "lineitem"), rules)


@q("agg_balance_check", """WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS s, sum(l_extendedprice * l_tax) AS t FROM lineitem GROUP BY 1), x AS (SELECT o_orderkey AS k, s AS assets, CASE WHEN o_orderkey % 17 <> 0 THEN s * (1 + (o_orderkey % 40) / 1000.0) END AS other, s / 2 AS b, CASE WHEN o_orderkey % 19 <> 0 THEN t END AS c, s / 2 + t + CASE WHEN o_orderkey % 5 = 0 THEN s / 20 ELSE 0 END AS e FROM orders JOIN s ON o_orderkey = l_orderkey),
 y AS (SELECT k, abs(assets - other) / greatest(abs(assets), 1) AS balance_error, abs(b + c - e) / greatest(abs(b + c), 1) AS cash_error FROM x)
 SELECT k AS o_orderkey, round(balance_error, 6) AS balance_error, round(cash_error, 6) AS cash_error, concat_ws(',', CASE WHEN balance_error IS NULL THEN 'balance fields missing' WHEN balance_error > 0.01 + 1e-9 THEN 'balance' END, CASE WHEN cash_error > 0.02 THEN 'cash roll-forward' END) AS errors, cash_error IS NULL AS incomplete FROM y WHERE balance_error IS NULL OR balance_error > 0.01 + 1e-9 OR cash_error > 0.02 OR cash_error IS NULL""")
def _(spark, d):
    """Orders as statements; some do not balance, some lack the total and have its parts, or lack all, and some cash does not roll forward."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("assets"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("t"))
    k, a = F.col("o_orderkey"), F.col("assets")
    other = F.when(k % 17 != 0, a * (1 + (k % 40) / 1000))
    x = table(spark, d, "orders").join(s, "o_orderkey").select(
        "o_orderkey", "assets", F.when(k % 3 != 0, other).alias("liab_equity"), (other / 4).alias("liabilities"), (other * 0.75).alias("equity"),
        (a / 2).alias("begin_cash"), F.when(k % 19 != 0, F.col("t")).alias("cash_change"), (a / 2 + F.col("t") + F.when(k % 5 == 0, a / 20).otherwise(0.0)).alias("end_cash"),
    )
    # A part of a thousandth stands at the bound itself, where sums of doubles differ.
    y = R.statement_checks(x, balance=0.01 + 1e-9).where("not usable or size(warnings) > 0")
    return y.select("o_orderkey", *r6("balance_error", "cash_error"), F.array_join("errors", ",").alias("errors"), (F.size("warnings") > 0).alias("incomplete"))


FIELDS = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@q("agg_constant_field", " UNION ALL ".join(f"SELECT l_returnflag AS book, '{c}' AS field, count({c}) AS n, count(DISTINCT {c}) AS distinct_values FROM lineitem GROUP BY 1 HAVING count({c}) >= 100 AND count(DISTINCT {c}) <= 1" for c in FIELDS))
def _(spark, d):
    """Fields that never change within the book of one return flag."""
    return R.constant_fields(table(spark, d, "lineitem").withColumn("book", F.col("l_returnflag")), FIELDS, by=["book"])


@q("agg_small_denominator", "SELECT c_custkey FROM customer WHERE abs(c_acctbal) < greatest(100.0, 0.02 * (SELECT max(c_acctbal) FROM customer))")
def _(spark, d):
    c = table(spark, d, "customer")
    top = c.agg(F.max("c_acctbal").alias("m"))
    return c.crossJoin(F.broadcast(top)).where(F.abs("c_acctbal") < F.greatest(F.lit(100.0), 0.02 * F.col("m"))).select("c_custkey")


@q("agg_catalog_stats", "SELECT p_brand, p_type, CASE WHEN grouping(p_brand) = 0 THEN 'brand' WHEN grouping(p_type) = 0 THEN 'type' ELSE 'all' END AS level, count(*) AS n FROM part GROUP BY GROUPING SETS ((), (p_brand), (p_type))")
def _(spark, d):
    g = table(spark, d, "part").groupingSets([[], ["p_brand"], ["p_type"]], "p_brand", "p_type")
    return g.agg(F.when(F.grouping("p_brand") == 0, "brand").when(F.grouping("p_type") == 0, "type").otherwise("all").alias("level"), F.count(F.lit(1)).alias("n"))


@q("agg_quorum_date", f"WITH {BARS}, n AS (SELECT count(DISTINCT code) AS n, max(trade_date) AS last FROM bars), p AS (SELECT trade_date, count(DISTINCT code) AS c FROM bars GROUP BY 1) SELECT coalesce(max(CASE WHEN c >= ceil(0.3 * n) THEN trade_date END), max(last)) AS quorum_date FROM p, n")
def _(spark, d):
    return R.quorum_date(bars(spark, d), "code", "trade_date", 0.3)


FIRMS = "firms AS (SELECT code, CASE WHEN code % 17 <> 3 THEN industry END AS industry FROM members)"


@q("agg_readiness", f"""WITH {PROBES}, {MEMBERS}, {FIRMS}, {FIGURES}, {VALUATIONS}, fin AS (SELECT DISTINCT code, available_at FROM figures WHERE coalesce(roe, gross_margin, cash, debt_ratio) IS NOT NULL), val AS (SELECT DISTINCT code, available_at FROM valuations WHERE coalesce(ep, bp) IS NOT NULL),
 x AS (SELECT p.at, p.code, b.trade_date AS traded, industry FROM probes p ASOF LEFT JOIN bars b ON p.code = b.code AND p.at >= b.trade_date LEFT JOIN firms f ON f.code = p.code),
 y AS (SELECT x.*, fin.available_at AS disclosed FROM x ASOF LEFT JOIN fin ON x.code = fin.code AND x.at >= fin.available_at), z AS (SELECT y.*, val.available_at AS valued FROM y ASOF LEFT JOIN val ON y.code = val.code AND y.at >= val.available_at),
 g AS (SELECT z.at, count(*) AS members, count(traded) AS prices, count(*) FILTER (WHERE z.at - traded <= 10) AS recent, count(industry) AS industries, count(disclosed) AS financials, count(valued) AS valuations, count(*) FILTER (WHERE z.at - valued <= 10) AS fresh_valuations,
  count(*) FILTER (WHERE traded IS NOT NULL AND industry IS NOT NULL AND disclosed IS NOT NULL AND valued IS NOT NULL) AS complete FROM z GROUP BY z.at)
 SELECT *, round(complete / members, 6) AS ratio, complete / members + 1e-12 < 0.6 AS rejected FROM g""")
def _(spark, d):
    """Coverage of each month's first day by prices, industries, figures and valuations known on it."""
    firms = members(spark, d).select("code", F.when(F.col("code") % 17 != 3, F.col("industry")).alias("industry"))
    x = FA.readiness(probes(spark, d), bars(spark, d), firms, figures(spark, d), valuations(spark, d), 0.6)
    return x.withColumn("ratio", F.round("ratio", 6))


@q("agg_sync_status", "SELECT user_id AS job, arg_max(event_type, event_id) AS last_status, count(*) AS runs, CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'success' WHEN count(*) FILTER (WHERE event_type = 'error') < count(*) THEN 'partial' ELSE 'failed' END AS outcome FROM events GROUP BY 1")
def _(spark, d):
    err = F.count(F.when(F.col("event_type") == "error", 1))
    return table(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_type", "event_id").alias("last_status"), F.count(F.lit(1)).alias("runs"), F.when(err == 0, "success").when(err < F.count(F.lit(1)), "partial").otherwise("failed").alias("outcome"))


FILLS = """fills AS (SELECT l_suppkey % 50 AS code, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size_bucket, l_linestatus AS session, l_returnflag AS algorithm, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sign, floor(l_quantity * 0.1) AS unfilled, l_quantity AS shares,
  p_retailprice AS decision, p_retailprice * (1 + l_discount / 10) AS arrival, p_retailprice * (1 + l_discount / 8) AS vwap, p_retailprice * (1 + l_tax / 5) AS last, CASE WHEN l_linenumber <> 5 THEN p_retailprice * (1 + l_tax / 4) END AS fill, l_extendedprice * l_tax * 0.01 AS fee FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@q("agg_tca", f"""WITH {FILLS}, c AS (SELECT code, size_bucket, session, algorithm, sign * (arrival - decision) * (shares - unfilled) AS delay, sign * (vwap - arrival) * (shares - unfilled) AS market, coalesce(sign * (fill - vwap) * (shares - unfilled), 0) AS impact, sign * (last - decision) * unfilled AS opportunity, fee AS fees FROM fills)
 SELECT code, size_bucket, session, algorithm, round(sum(delay), 4) AS delay, round(sum(market), 4) AS market, round(sum(impact), 4) AS impact, round(sum(opportunity), 4) AS opportunity, round(sum(fees), 4) AS fees, round(sum(delay + market + impact + opportunity + fees), 4) AS shortfall FROM c GROUP BY GROUPING SETS ((), (code), (size_bucket), (session), (algorithm))""")
def _(spark, d):
    """Orders from lines: prices around the part's retail price, a tenth of the shares unfilled, no fill price where the line number is 5."""
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    p, q = F.col("p_retailprice"), F.col("l_quantity")
    x = j.select(
        (F.col("l_suppkey") % 50).alias("code"), F.when(q < 10, "small").when(q < 30, "medium").otherwise("large").alias("size_bucket"), F.col("l_linestatus").alias("session"), F.col("l_returnflag").alias("algorithm"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.floor(q * 0.1).alias("unfilled"), q.alias("shares"), p.alias("decision"), (p * (1 + F.col("l_discount") / 10)).alias("arrival"), (p * (1 + F.col("l_discount") / 8)).alias("vwap"),
        (p * (1 + F.col("l_tax") / 5)).alias("last"), F.when(F.col("l_linenumber") != 5, p * (1 + F.col("l_tax") / 4)).alias("fill"), (F.col("l_extendedprice") * F.col("l_tax") * 0.01).alias("fee"),
    )
    by = ["code", "size_bucket", "session", "algorithm"]
    return R.cost_analysis(x, by).select(*by, *[F.round(c, 4).alias(c) for c in ("delay", "market", "impact", "opportunity", "fees", "shortfall")])


@q("agg_exec_calibration", "WITH x AS (SELECT l_returnflag AS g, l_discount - 0.001 AS y, sqrt(l_quantity / 50) AS a, l_tax AS b FROM lineitem), s AS (SELECT g, sum(a*a) AS s11, sum(a*b) AS s12, sum(b*b) AS s22, sum(a*y) AS s1, sum(b*y) AS s2 FROM x GROUP BY 1), f AS (SELECT g, greatest(0, (s1*s22 - s2*s12) / (s11*s22 - s12*s12)) AS a0, greatest(0, (s2*s11 - s1*s12) / (s11*s22 - s12*s12)) AS b0 FROM s) SELECT x.g AS l_returnflag, round(any_value(a0), 6) AS a, round(any_value(b0), 6) AS b, round(avg(y - a0*a - b0*b), 6) AS bias, round(avg(abs(y - a0*a - b0*b)), 6) AS mae FROM x JOIN f ON x.g = f.g GROUP BY x.g")
def _(spark, d):
    x = table(spark, d, "lineitem").withColumn("root", F.sqrt(F.col("l_quantity") / 50))
    return R.calibrate(x, "l_returnflag", "l_discount", "root", "l_tax", 0.001).select("l_returnflag", *r6("a", "b", "bias", "mae"))


@q("agg_exec_buckets", """SELECT l_returnflag, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS l_quantity_bucket, CASE WHEN l_tax < 0.015 THEN 'low_vol' WHEN l_tax < 0.035 THEN 'mid_vol' ELSE 'high_vol' END AS l_tax_bucket, count(*) AS n, round(avg(l_discount), 6) AS mean
 FROM lineitem GROUP BY 1, 2, 3""")
def _(spark, d):
    """Mean shortfall by side, size and volatility."""
    cuts = {"l_quantity": ([10, 30], ["small", "medium", "large"]), "l_tax": ([0.015, 0.035], ["low_vol", "mid_vol", "high_vol"])}
    return R.bucket_means(table(spark, d, "lineitem"), ["l_returnflag"], cuts, "l_discount").select("l_returnflag", "l_quantity_bucket", "l_tax_bucket", "n", *r6("mean"))


@q("agg_factor_health", f"""WITH {RAW}, l AS (SELECT month, u.f AS factor, u.v FROM rawm, LATERAL (VALUES ('mom', mom), ('rev', rev), ('vol', vol), ('dd', dd)) u(f, v)),
 g AS (SELECT factor, month, count(v) * 1.0 / count(*) AS coverage, count(DISTINCT v) AS unique_values, min(v) AS low, quantile_cont(v, 0.01) AS q01, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.99) AS q99, max(v) AS high FROM l GROUP BY 1, 2),
 h AS (SELECT *, lag(median) OVER (PARTITION BY factor ORDER BY month) AS b FROM g), k AS (SELECT *, CASE WHEN abs(median) > 1e-12 AND abs(b) > 1e-12 THEN abs(median / b) END AS ratio FROM h),
 r AS (SELECT *, concat_ws(',', CASE WHEN coverage < 0.8 THEN 'coverage' END, CASE WHEN unique_values < 5 THEN 'constant' END, CASE WHEN ratio > 100 OR ratio < 0.01 THEN 'scale' END, CASE WHEN ratio IS NOT NULL AND factor IN ('vol', 'dd') AND median * b < 0 THEN 'sign' END) AS reasons FROM k)
 SELECT factor, month, round(coverage, 6) AS coverage, unique_values, round(low, 6) AS low, round(q01, 6) AS q01, round(median, 6) AS median, round(q99, 6) AS q99, round(high, 6) AS high, round(ratio, 4) AS scale_ratio, reasons, reasons <> '' AS blocked FROM r""")
def _(spark, d):
    x = raw_panel(spark, d).unpivot(["code", "month"], ["mom", "rev", "vol", "dd"], "factor", "value")
    x = R.against_history(R.health(x, ["factor", "month"], "value", F.count(F.lit(1))), "factor", "month", ["vol", "dd"])
    return x.select("factor", "month", *r6("coverage"), "unique_values", *r6("low", "q01", "median", "q99", "high"), F.round("scale_ratio", 4).alias("scale_ratio"), "reasons", "blocked")


@q("agg_turnover", f"WITH {POSITIONS}, t AS (SELECT account, fund, value / sum(value) OVER (PARTITION BY account) AS w FROM positions), b AS (SELECT account, fund, cost / sum(cost) OVER (PARTITION BY account) AS w FROM positions WHERE fund % 4 <> 0), j AS (SELECT coalesce(t.account, b.account) AS account, coalesce(t.w, 0) AS a, coalesce(b.w, 0) AS b FROM t FULL JOIN b ON t.account = b.account AND t.fund = b.fund) SELECT account, round(0.5 * (sum(abs(a - b)) + abs(sum(b) - sum(a))), 6) AS turnover FROM j GROUP BY 1")
def _(spark, d):
    p, w = positions(spark, d), Window.partitionBy("account")
    t = p.select("account", "fund", (F.col("value") / F.sum("value").over(w)).alias("weight"))
    b = p.where("fund % 4 <> 0").select("account", "fund", (F.col("cost") / F.sum("cost").over(w)).alias("weight"))
    return R.turnover(t, b, "account", "fund").select("account", *r6("turnover"))


@q("join_lookthrough", f"WITH {POSITIONS}, h AS (SELECT l_partkey AS fund, l_suppkey AS item, sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_partkey) AS weight FROM lineitem GROUP BY 1, 2) SELECT item, round(sum(value * weight), 2) AS exposure, count(DISTINCT fund) AS funds FROM (SELECT fund, sum(value) AS value FROM positions GROUP BY 1) JOIN h USING (fund) GROUP BY item")
def _(spark, d):
    h = table(spark, d, "lineitem").select(F.col("l_partkey").alias("fund"), F.col("l_suppkey").alias("item"), F.col("l_quantity").alias("quantity"))
    p = positions(spark, d).select("fund", "value")
    return R.lookthrough(p, h).select("item", F.round("exposure", 2).alias("exposure"), "funds")


@q("join_combine_weights", f"WITH {MEMBERS}, a AS (SELECT code, cap AS w FROM members), b AS (SELECT code, 1.0 AS w FROM members WHERE code % 2 = 0), u AS (SELECT code, 0.5 * w / sum(w) OVER () AS w FROM a UNION ALL SELECT code, 0.5 * w / sum(w) OVER () FROM b) SELECT code, round(sum(w), 8) AS weight FROM u GROUP BY 1")
def _(spark, d):
    m = members(spark, d)
    x = R.combine_books(m.select("code", F.col("cap").alias("weight")), m.where("code % 2 = 0").select("code", F.lit(1.0).alias("weight")), "code")
    return x.select("code", F.round("weight", 8).alias("weight"))


@q("join_cross_source", f"WITH {REVISIONS}, k AS (SELECT code, effective_date, min(value) FILTER (WHERE source = 'lines') AS a, min(value) FILTER (WHERE source = 'orders') AS b FROM revisions GROUP BY 1, 2) SELECT code, effective_date, coalesce(a, b) AS value, CASE WHEN a IS NULL OR b IS NULL THEN 'single_source' WHEN abs(a - b) / greatest(abs(a), 1e-9) <= 0.1 THEN 'matched' WHEN abs(a - b) / greatest(abs(a), 1e-9) <= 0.5 THEN 'degraded' ELSE 'review_required' END AS status FROM k")
def _(spark, d):
    x = revisions(spark, d).groupBy("code", "effective_date", F.when(F.col("source") == "lines", 1).otherwise(2).alias("prio")).agg(F.min("value").alias("value"))
    return R.reconcile_field(x, ["code", "effective_date"], 0.1)


@q("join_self_periods", "WITH m AS (SELECT o_custkey % 50 AS code, extract(year FROM o_orderdate) AS year, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1, 2) SELECT a.code, a.year, CAST(a.v AS DOUBLE) AS v, CAST(b.v AS DOUBLE) AS prior FROM m a LEFT JOIN m b ON a.code = b.code AND b.year = a.year - 1")
def _(spark, d):
    m = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("code"), F.year("o_orderdate").cast("long").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    return m.join(m.select("code", (F.col("year") + 1).alias("year"), F.col("v").alias("prior")), ["code", "year"], "left")


@q("join_interval_overlap", "WITH iv AS (SELECT DISTINCT o_custkey AS code, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + 60 AS end_date FROM orders) SELECT code, start_date, end_date FROM iv WHERE start_date <= DATE '1997-03-31' AND end_date >= DATE '1997-01-01'")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("start_date")).distinct().withColumn("end_date", F.date_add("start_date", 60))
    return o.where("start_date <= '1997-03-31' and end_date >= '1997-01-01'")


@q("join_orphans", """WITH f AS (SELECT l_orderkey AS k, sum(l_quantity) AS q, count(*) AS n FROM lineitem WHERE l_orderkey % 3 <> 1 OR l_linenumber > 1 GROUP BY 1), o AS (SELECT o_orderkey AS k, CAST(60 + o_orderkey % 100 AS DOUBLE) AS q FROM orders WHERE o_orderkey % 31 <> 0),
 j AS (SELECT f.q AS filled, o.q AS q, n FROM o FULL JOIN f ON o.k = f.k), c AS (SELECT sum(l_extendedprice * l_tax) - sum(CASE WHEN l_orderkey % 701 <> 0 THEN round(l_extendedprice * l_tax, 2) ELSE 0 END) AS e FROM lineitem GROUP BY CAST(l_shipdate AS DATE))
 SELECT 'orphan_fills' AS kind, CAST(coalesce(sum(n) FILTER (WHERE q IS NULL), 0) AS BIGINT) AS n FROM j UNION ALL SELECT 'overfilled_orders', count(*) FILTER (WHERE filled > q) FROM j UNION ALL SELECT 'conservation_breaks', count(*) FILTER (WHERE abs(e) > 5) FROM c""")
def _(spark, d):
    """Lines as fills of orders of which some are gone, and days whose booked taxes leave some out."""
    l, day = table(spark, d, "lineitem"), F.to_date("l_shipdate")
    fills = l.where("l_orderkey % 3 <> 1 or l_linenumber > 1").select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("quantity"))
    orders = table(spark, d, "orders").where("o_orderkey % 31 <> 0").select(F.col("o_orderkey").alias("order_id"), (F.col("o_orderkey") % 100 + 60).cast("double").alias("quantity"))
    tax = F.col("l_extendedprice") * F.col("l_tax")
    days = l.groupBy(day.alias("day")).agg((F.sum(tax) - F.sum(F.when(F.col("l_orderkey") % 701 != 0, F.round(tax, 2)).otherwise(0.0))).alias("conservation_error"))
    return R.ledger_invariants(orders, fills, days, most=5.0)


@q("join_suspend_absent", f"WITH {BARS} SELECT s_suppkey AS code FROM supplier WHERE s_suppkey NOT IN (SELECT code FROM bars WHERE trade_date = DATE '1998-06-15')")
def _(spark, d):
    today = bars(spark, d).where("trade_date = '1998-06-15'").select("code")
    return L.absent(table(spark, d, "supplier").select(F.col("s_suppkey").alias("code")), today, "code")


@q("join_limits_derived", f"WITH {PROBES} SELECT p.code, p.at, round(ln(b.close * 1.1), 6) AS up, round(ln(b.close * 0.9), 6) AS down FROM probes p ASOF LEFT JOIN bars b ON p.code = b.code AND p.at > b.trade_date")
def _(spark, d):
    x = A.asof_join(probes(spark, d), bars(spark, d), "code", "at", "trade_date", ["close"], strict=True)
    return x.select("code", "at", F.round(F.log(F.col("close") * 1.1), 6).alias("up"), F.round(F.log(F.col("close") * 0.9), 6).alias("down"))


@q("join_contains_constant", "SELECT DISTINCT doc_id, kw FROM documents, (VALUES ('license'), ('password'), ('idiot'), ('the and')) k(kw) WHERE contains(lower(text), kw)")
def _(spark, d):
    return R.keyword_hits(table(spark, d, "documents"), "text", ["license", "password", "idiot", "the and"]).select("doc_id", "kw").distinct()


@q("join_contains", r"""WITH k AS (SELECT DISTINCT item_id AS code, unnest(string_split_regex(text, '[^A-Za-z]+')) AS keyword FROM benchmark), w AS (SELECT keyword, list(CAST(code AS VARCHAR)) AS codes FROM k WHERE length(keyword) >= 7 GROUP BY 1),
 m AS (SELECT doc_id, unnest(codes) AS code FROM documents JOIN w ON contains(text, keyword)), g AS (SELECT doc_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, count(DISTINCT code) AS n FROM m GROUP BY 1)
 SELECT doc_id, coalesce(codes, '') AS codes, CAST(coalesce(n, 0) AS INT) AS n FROM documents LEFT JOIN g USING (doc_id)""")
def _(spark, d):
    """Codes named in each text: a test item's longer words are its keywords."""
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("code"), F.explode(F.split("text", "[^A-Za-z]+")).alias("keyword")).where(F.length("keyword") >= 7)
    got = K.match_codes(table(spark, d, "documents"), words, "doc_id", "text")
    return got.select("doc_id", F.array_join("codes", ",").alias("codes"), F.size("codes").alias("n"))


@q("top_leaderboard", f"WITH {RAW} SELECT code, round(mom, 6) AS mom, rank, total FROM (SELECT code, mom, row_number() OVER (ORDER BY mom DESC NULLS LAST, code) AS rank, count(*) OVER () AS total FROM rawm WHERE month = DATE '2000-05-01') WHERE rank > 10 AND rank <= 30")
def _(spark, d):
    x = raw_panel(spark, d).where("month = '2000-05-01'").select("code", "mom")
    return R.page(x, [F.desc_nulls_last("mom"), F.asc("code")], 20, 10).select("code", *r6("mom"), "rank", "total")


@q("top_dual_momentum", f"WITH {RAW}, k AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY mom DESC NULLS LAST, code) AS r FROM rawm) SELECT month, code, CASE WHEN mom > 0 THEN 0.2 ELSE 0.0 END AS weight FROM k WHERE r <= 5")
def _(spark, d):
    x = raw_panel(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("month").orderBy(F.desc_nulls_last("mom"), "code"))).where("r <= 5")
    return x.select("month", "code", F.when(F.col("mom") > 0, 0.2).otherwise(0.0).alias("weight"))


@q("top_ratio_per_group", f"WITH {MEMBERS}, k AS (SELECT code, market, row_number() OVER (PARTITION BY market ORDER BY cap DESC NULLS LAST, code) AS r, count(*) OVER (PARTITION BY market) AS n FROM members) SELECT code, market FROM k WHERE r <= greatest(1, ceil(n * 0.3))")
def _(spark, d):
    return R.top_ratio(members(spark, d), "market", "cap", 0.3).select("code", "market")


TIERS = "t AS (SELECT p_partkey AS code, CASE WHEN p_size <= 5 THEN 'A' WHEN p_size <= 30 THEN 'B' ELSE 'C' END AS tier FROM part)"


@q("top_tier_quota", f"WITH {TIERS}, k AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY code) AS k, CASE tier WHEN 'A' THEN 350 WHEN 'B' THEN 125 ELSE 25 END AS quota FROM t), r AS (SELECT code, tier, row_number() OVER (ORDER BY tier, code) AS r FROM k WHERE k > quota) SELECT code, tier FROM k WHERE k <= quota UNION ALL SELECT code, tier FROM r WHERE r <= 500 - (SELECT count(*) FROM k WHERE k <= quota)")
def _(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.when(F.col("p_size") <= 5, "A").when(F.col("p_size") <= 30, "B").otherwise("C").alias("tier"))
    return R.tier_quota(t, [("A", 0.7), ("B", 0.25), ("C", 0.05)], 500)


@q("top_dedupe_family", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS k FROM part) WHERE k = 1")
def _(spark, d):
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey"))
    return table(spark, d, "part").withColumn("k", k).where("k = 1").select("p_brand", "p_partkey")


@q("top_weighted_candidates")
def _(spark, d):
    x = raw_panel(spark, d).where("mom is not null").select(F.col("month"), "code", F.col("mom").alias("score"))
    k = F.row_number().over(Window.partitionBy("month").orderBy(F.desc("score"), "code"))
    return R.capped_weights(x.withColumn("k", k).where("k <= 10"), "month", 0.2).select("month", "code", *r6("weight"))


@q("top_sample_curve", f"WITH {BARS}, x AS (SELECT code, trade_date, volume, row_number() OVER (PARTITION BY code ORDER BY trade_date) - 1 AS i, count(*) OVER (PARTITION BY code) AS n FROM bars) SELECT code, trade_date, volume FROM x WHERE n <= 50 OR i = 0 OR floor(i * 49 / (n - 1)) > floor((i - 1) * 49 / (n - 1))")
def _(spark, d):
    return R.evenly_spaced(bars(spark, d).select("code", "trade_date", "volume"), "code", "trade_date", 50)


@q("top_v2_select", f"WITH {RAW}, {MEMBERS}, f AS (SELECT r.*, market, industry, row_number() OVER (PARTITION BY month, industry ORDER BY mom DESC, r.code) AS k FROM rawm r JOIN members USING (code) WHERE mom > 0), g AS (SELECT *, row_number() OVER (PARTITION BY month, market ORDER BY mom DESC, code) AS r, count(*) OVER (PARTITION BY month, market) AS n FROM f WHERE k = 1) SELECT month, code, market FROM g WHERE r <= greatest(1, ceil(n * 0.3))")
def _(spark, d):
    x = raw_panel(spark, d).where("mom > 0").join(members(spark, d), "code")
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("month", "industry").orderBy(F.desc("mom"), "code"))).where("k = 1").withColumn("g", F.struct("month", "market"))
    return R.top_ratio(x, "g", "mom", 0.3).select("month", "code", "market")


@q("top_rank_fractions", f"WITH {RAW}, x AS (SELECT code, month, mom FROM rawm WHERE mom IS NOT NULL), y AS (SELECT code, month, rank() OVER (PARTITION BY month ORDER BY mom) - 1 AS below, count(*) OVER (PARTITION BY month, mom) AS equal, count(*) OVER (PARTITION BY month) AS n FROM x) SELECT code, month, round(CASE WHEN n = 1 THEN 1.0 ELSE (2 * below + equal - 1) / 2.0 / (n - 1) END, 6) AS fraction FROM y")
def _(spark, d):
    w = Window.partitionBy("month")
    x = raw_panel(spark, d).where("mom is not null")
    n, below, equal = F.count(F.lit(1)).over(w), F.rank().over(w.orderBy("mom")) - 1, F.count(F.lit(1)).over(Window.partitionBy("month", "mom"))
    return x.select("code", "month", F.round(F.when(n == 1, 1.0).otherwise((2 * below + equal - 1) / 2 / (n - 1)), 6).alias("fraction"))


@q("set_union_by_name", "SELECT s_suppkey AS code, s_name AS name, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@q("set_intersect_except", "SELECT 'both' AS part, k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') UNION ALL SELECT 'lost', k FROM (SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, d):
    keys = lambda f: table(spark, d, "lineitem").where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    both = keys("R").intersect(keys("A")).select(F.lit("both").alias("part"), "k")
    lost = table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(keys("R")).select(F.lit("lost").alias("part"), "k")
    return both.unionByName(lost)


@q("set_distinct_sources", "SELECT DISTINCT source, lang FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("source", "lang").distinct()


@q("set_repo_fallback", f"WITH {REVISIONS}, p AS (SELECT *, CASE source WHEN 'lines' THEN 1 ELSE 2 END AS prio FROM revisions) SELECT code, effective_date, source, value FROM p JOIN (SELECT code, min(prio) AS m FROM p GROUP BY 1) b USING (code) WHERE prio = m")
def _(spark, d):
    x = revisions(spark, d).withColumn("prio", F.when(F.col("source") == "lines", 1).otherwise(2))
    return R.first_source(x, ["code"], "prio").select("code", "effective_date", "source", "value")


@q("derive_membership_events", "WITH s AS (SELECT DISTINCT l_returnflag AS idx, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS day, l_partkey AS code FROM lineitem), dd AS (SELECT idx, day, lag(day) OVER (PARTITION BY idx ORDER BY day) AS prev, lead(day) OVER (PARTITION BY idx ORDER BY day) AS next FROM (SELECT DISTINCT idx, day FROM s)) SELECT s.idx, s.code, s.day AS effective_date, 'add' AS event_type FROM s JOIN dd USING (idx, day) WHERE prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.idx = s.idx AND o.code = s.code AND o.day = dd.prev) UNION ALL SELECT s.idx, s.code, dd.next, 'remove' FROM s JOIN dd USING (idx, day) WHERE next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.idx = s.idx AND o.code = s.code AND o.day = dd.next)")
def _(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("idx"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("day"), F.col("l_partkey").alias("code"))
    return R.set_difference_events(s, "idx", "code", "day")
