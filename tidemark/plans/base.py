"""Binding of the operators to the driver's tables: each relation once for Spark and once as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(*names: str) -> list:
    """Rounded columns: sums differ in their last digits between engines."""
    return [F.round(n, 6).alias(n) for n in names]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each supplier: prices per unit, volume, amount."""
    p = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("trade_date")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.max(p).alias("high"), F.min(p).alias("low"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount")
    )


BARS = """bars AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS trade_date, sum(l_extendedprice) / sum(l_quantity) AS close,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM lineitem GROUP BY 1, 2)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with nation as industry and region as market; cap from the account balance."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    j = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return j.select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("n_name").alias("industry"), F.col("r_name").alias("market"), (F.abs("s_acctbal") + 1000).alias("cap"))


MEMBERS = """members AS (SELECT s_suppkey AS code, s_name AS name, n_name AS industry, r_name AS market, abs(s_acctbal) + 1000 AS cap
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned order values: each order once when placed and, if it is in the line table, again as revised by its lines."""
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    first = o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("code"), day.alias("effective_date"), F.date_add(day, (F.col("o_orderkey") % 90).cast("int")).alias("available_at"), F.col("o_orderkey").alias("ingest_no"), F.lit("orders").alias("source"), F.round("o_totalprice", 2).alias("value"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("value"), F.max(F.to_date("l_shipdate")).alias("shipped"))
    second = lines.join(o, lines.l_orderkey == o.o_orderkey).select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("code"), day.alias("effective_date"), F.greatest(F.date_add(day, 30), "shipped").alias("available_at"), (F.col("o_orderkey") + 100000000).alias("ingest_no"), F.lit("lines").alias("source"), "value")
    return first.unionByName(second)


REVISIONS = """revisions AS (
  SELECT 'C' || o_custkey AS code, CAST(o_orderdate AS DATE) AS effective_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS available_at,
    o_orderkey AS ingest_no, 'orders' AS source, round(o_totalprice, 2) AS value FROM orders
  UNION ALL
  SELECT 'C' || o_custkey, CAST(o_orderdate AS DATE), greatest(CAST(o_orderdate AS DATE) + 30, shipped), o_orderkey + 100000000, 'lines', value
  FROM (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS value, max(CAST(l_shipdate AS DATE)) AS shipped FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey)"""


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly figures of each supplier from its lines, disclosed 20 to 79 days after the quarter's end; some leave fields out."""
    price, code = F.col("l_extendedprice"), F.col("l_suppkey")
    period = F.to_date(F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2)))
    g = table(spark, sf_dir, "lineitem").groupBy(code.alias("code"), period.alias("period")).agg(
        F.sum(price).alias("revenue"), F.sum(price * (F.lit(0.06) - F.col("l_discount"))).alias("net_income"), F.sum(price * (F.col("l_tax") - 0.02)).alias("cash"), (F.sum("l_quantity") * 1000).alias("assets")
    )
    k = F.col("code")
    return g.select(
        "code", "period", F.date_add("period", (20 + k % 60).cast("int")).alias("available_at"), F.when(k % 9 != 4, F.col("net_income") / F.col("assets") * 2).alias("roe"), F.when(k % 5 != 1, F.col("cash") / F.col("revenue")).alias("gross_margin"),
        (F.col("net_income") / F.col("revenue")).alias("net_margin"), F.when(k % 4 != 3, F.col("assets") / F.col("revenue")).alias("debt_ratio"), "net_income", "cash", "assets",
    )


FIGURES = """fg AS (SELECT l_suppkey AS code, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH AS DATE) - 1 AS period, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (0.06 - l_discount)) AS net_income,
  sum(l_extendedprice * (l_tax - 0.02)) AS cash, sum(l_quantity) * 1000 AS assets FROM lineitem GROUP BY 1, 2),
 figures AS (SELECT code, period, period + 20 + CAST(code % 60 AS INTEGER) AS available_at, CASE WHEN code % 9 <> 4 THEN net_income / assets * 2 END AS roe, CASE WHEN code % 5 <> 1 THEN cash / revenue END AS gross_margin,
  net_income / revenue AS net_margin, CASE WHEN code % 4 <> 3 THEN assets / revenue END AS debt_ratio, net_income, cash, assets FROM fg)"""


def valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A valuation of each supplier at its last bar of each month; some have no ep, some no bp."""
    last = bars(spark, sf_dir).groupBy("code", F.trunc("trade_date", "MM").alias("month")).agg(F.max_by("close", "trade_date").alias("close"), F.max("trade_date").alias("available_at"))
    k, c = F.col("code"), F.col("close")
    return last.select("code", "available_at", F.when(k % 7 != 2, (k % 6 - 1) / c).alias("ep"), F.when(k % 11 != 5, 500 / c).alias("bp"), (c * 1000).alias("market_cap"))


VALUATIONS = """valuations AS (SELECT code, max(trade_date) AS available_at, CASE WHEN code % 7 <> 2 THEN (code % 6 - 1) / arg_max(close, trade_date) END AS ep, CASE WHEN code % 11 <> 5 THEN 500 / arg_max(close, trade_date) END AS bp,
  arg_max(close, trade_date) * 1000 AS market_cap FROM bars GROUP BY code, date_trunc('month', trade_date))"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items from documents: the first line as title, a time from the id."""
    d = table(spark, sf_dir, "documents")
    title = F.split("text", "\n")[0]
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 720 as int))")
    return d.select(F.col("doc_id").alias("news_id"), "source", title.alias("title"), F.col("text").alias("summary"), at.alias("published_at"), "lang")


NEWS = """news AS (SELECT doc_id AS news_id, source, split_part(text, chr(10), 1) AS title, text AS summary,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS published_at, lang FROM documents)"""
