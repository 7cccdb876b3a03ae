"""Vendor mappings, statement merges, event ledgers and portfolio aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.lake import written


def jdbc_table(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A relational table read in ranges of one numeric column."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return r.options(**options).load()


def database(spark: SparkSession, folder: str) -> str:
    """The address of a relational database: ``tidemark.jdbc.url`` of the session, or an embedded one below ``folder``. An embedded database is open to one
    process, so it serves local mode only; on a cluster the address has to be given."""
    given = spark.conf.get("tidemark.jdbc.url", None)
    if given:
        return given
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("tidemark.jdbc.url must name a database that all executors reach")
    path = folder.removeprefix("file://").removeprefix("file:")
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{path}.log")
    return f"jdbc:derby:{path};create=true"


def to_database(df: DataFrame, url: str, table: str, parts: int = 4, longest: int = 255) -> None:
    """Write a table. Its columns are named in capitals, as names without quotes are read; texts have at most ``longest`` characters, so that they can be compared."""
    texts = ", ".join(f"{f.name.upper()} VARCHAR({longest})" for f in df.schema.fields if f.dataType.simpleString() == "string")
    options = {"url": url, "dbtable": table, "numPartitions": parts, "batchsize": 10_000, **({"createTableColumnTypes": texts} if texts else {})}
    df.toDF(*[c.upper() for c in df.columns]).write.format("jdbc").options(**options).mode("overwrite").save()


def fund_navs(spark: SparkSession, url: str, parts: int, codes: list[str] | None = None, **options: str) -> DataFrame:
    """NAVs joined to their instruments, as rows of the dataset fund_nav: fund_code, effective_date, nav, accumulated_nav, daily_return; of some ``codes`` only, if
    given. The table is read in as many ranges of its instrument, between the smallest and the largest that the database tells."""
    ends = spark.read.format("jdbc").options(url=url, query="SELECT min(instrument_id) AS low, max(instrument_id) AS high FROM fund_navs", **options).load().first()
    ends = {k.lower(): v for k, v in ends.asDict().items()}
    if ends["low"] is None:
        ends = {"low": 0, "high": 1}
    navs = jdbc_table(spark, url, "fund_navs", "instrument_id", int(ends["low"]), int(ends["high"]) + 1, parts, **options)
    names = spark.read.format("jdbc").options(url=url, dbtable="instruments", **options).load()
    if codes is not None:
        names = names.where(F.col("code").isin(codes))
    j = navs.join(names, navs["instrument_id"] == names["id"])
    return map_columns(j, {"fund_code": F.col("code"), "effective_date": F.col("nav_date"), "nav": F.col("unit_nav"), "accumulated_nav": F.col("accumulated_nav"), "daily_return": F.col("daily_growth_rate")})


def map_columns(df: DataFrame, mapping: dict[str, Column]) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in mapping.items()])


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def merge_statements(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of statement tables on their keys; available when the last of them is."""
    out, dates = None, []
    for i, p in enumerate(parts):
        x = p.withColumnRenamed("available_at", f"__at{i}")
        dates.append(f"__at{i}")
        out = x if out is None else out.join(x, keys, "full")
    return out.withColumn("available_at", F.greatest(*dates)).drop(*dates)


def entitlements(df: DataFrame) -> DataFrame:
    """Share and cash events of dividend rows (code, day, shares, cash), with a key made of day and amounts."""
    kinds = F.array_compact(F.array(F.when(F.col("shares") > 0, F.struct(F.lit("shares").alias("kind"), F.col("shares").alias("amount"))), F.when(F.col("cash") > 0, F.struct(F.lit("cash").alias("kind"), F.col("cash").alias("amount")))))
    return df.select("code", "day", F.explode(kinds).alias("e")).select("code", "day", "e.kind", "e.amount")


def gate_all(df: DataFrame, by: str, check: Column) -> DataFrame:
    """Each group's check, and whether all groups pass (a switch happens for all or for none)."""
    g = df.groupBy(by).agg(check.alias("ok"))
    return g.withColumn("switch", F.min(F.col("ok").cast("int")).over(Window.partitionBy(F.lit(1))) == 1)


def name_periods(df: DataFrame) -> DataFrame:
    """Ordered name periods: the end is the day before the next start; an ST flag from the name."""
    w = Window.partitionBy("code").orderBy("start_date", "name")
    return df.withColumn("end_date", F.date_sub(F.lead("start_date").over(w), 1)).withColumn("st", F.col("name").rlike("^\\*?ST"))


def name_segments(names: DataFrame, text: str) -> DataFrame:
    """Former names in one text, oldest first (``A->B``, ``A/B`` or with commas, notes in brackets cut off), a row each: position from 0, name, st. A name that
    follows itself is told once."""
    parts = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "->|\u2192|/|\uff0c|,"), lambda x: F.trim(F.regexp_replace(x, "[(\uff08].*$", "")))
    some = F.filter(parts, lambda x: x != "")
    kept = F.filter(some, lambda x, i: (i == 0) | (x != F.get(some, i - 1)))
    rest = [c for c in names.columns if c != text]
    return names.select(*rest, F.posexplode(kept).alias("position", "name")).withColumn("st", F.col("name").rlike("^\\*?ST"))


def first_industry(rows: DataFrame) -> DataFrame:
    """Level-1 industry of each code from snapshot rows (ts_code, name, l1_code, l1_name, in_date): the latest row with a name of the industry; the code is what stands
    before the point, filled with zeros up to six; longer ones stay whole."""
    code = F.split("ts_code", "[.]")[0]
    code = F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code)
    some = rows.where(F.trim(F.coalesce("l1_name", F.lit(""))) != "")
    x = some.select(code.alias("code"), F.nullif(F.trim("name"), F.lit("")).alias("name"), F.nullif(F.trim("l1_code"), F.lit("")).alias("industry_code"), F.trim("l1_name").alias("industry"), "in_date")
    return newest(x, ["code"], [F.desc("in_date"), F.asc("industry")]).drop("in_date")


#: Pairs of an account and a stock that one task sums in memory.
PAIRS_A_TASK = 2_000_000
#: Buckets of stocks, and steps of a weight in parts of its fund's largest: together two bytes.
BUCKETS, STEPS = 1024, 63


def exposure_signals(positions: DataFrame, holdings: DataFrame, industries: DataFrame) -> DataFrame:
    """Of each account: stocks that it holds through its funds (5 % and more, risk from 10 %), stocks that two or more of its funds hold (2 % and more together), and
    industries (20 % and more, risk from 35 %).

    Positions (account, fund, value), holdings (fund, item, weight), industries (fund, industry, weight): account, kind, subject, level, exposure, funds.

    A position is sent to its account's task once, with its fund's industries and, in two bytes a stock, the stock's bucket and a weight that is no less
    than its own. The sums of an account's buckets are no less than those of their stocks: only stocks in buckets that reach a limit are then summed by
    their own weights, so that none is lost and few are sent whole.
    """
    p = written(positions.groupBy("account", "fund").agg(F.sum("value").alias("value")), "positions")

    def packed(table: DataFrame, item: str, name: str) -> DataFrame:
        each = table.groupBy("fund", item).agg(F.sum("weight").alias("weight"))
        x = each.groupBy("fund").agg(F.collect_list(F.struct(F.col(item).alias("s"), F.col("weight").alias("v"))).alias("x"), F.max(F.abs("weight")).alias(f"{name}_top"))
        return x.select("fund", F.transform("x", lambda e: e["s"]).alias(f"{name}_s"), F.transform("x", lambda e: e["v"]).alias(f"{name}_v"), f"{name}_top")

    names = written(industries.select("industry").distinct(), "industries").withColumn("id", F.monotonically_increasing_id())
    numbered = industries.join(names.withColumnRenamed("industry", "name"), F.col("industry").eqNullSafe(F.col("name"))).select("fund", "id", "weight")
    bucket = lambda s: F.pmod(F.xxhash64(s), F.lit(BUCKETS))
    top = F.col("stock_top")
    plain = (top > 0) & (top < float("inf"))

    def code(s, v):
        # Where the largest is no plain number, it makes the sum one that reaches every limit.
        step = F.when(plain, F.ceil(F.abs(v) / top * STEPS)).otherwise(STEPS)
        return (bucket(s) * (STEPS + 1) + F.coalesce(step, F.lit(0)) - 32768).cast("smallint")

    funds = packed(holdings, "item", "stock").join(packed(numbered, "id", "group").drop("group_top"), "fund", "full")
    funds = written(funds.withColumn("codes", F.zip_with("stock_s", "stock_v", code)), "funds")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    pairs = p.count() * (funds.agg(F.avg(size("codes") + size("group_s"))).first()[0] or 0)
    parts = max(int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // PAIRS_A_TASK) + 1)
    met = p.join(funds.select("fund", "codes", "stock_top", "group_s", "group_v"), "fund", "left").drop("fund").repartition(parts, "account")
    # An account's total takes all its positions, also those of funds without holdings.
    met = met.withColumn("total", F.sum("value").over(Window.partitionBy("account"))).where("total > 0").withColumn("w", F.col("value") / F.col("total"))
    place = lambda c: c.cast("int") + 32768
    most = lambda c: F.coalesce(F.abs(F.col("w")) * top * F.pmod(place(c), F.lit(STEPS + 1)) / STEPS, F.lit(0.0))
    stocks = F.coalesce(F.transform("codes", lambda c: F.struct(F.lit(0).alias("kind"), F.shiftright(place(c), 6).cast("long").alias("key"), most(c).alias("v"))), F.array())
    groups = F.coalesce(F.zip_with("group_s", "group_v", lambda s, v: F.struct(F.lit(1).alias("kind"), s.alias("key"), (F.col("w") * v).alias("v"))), F.array())
    # The outer form, as the plain one asks first whether the array is empty, and computes it twice for that.
    x = met.select("account", "total", F.explode_outer(F.concat(stocks, groups)).alias("x")).where("x is not null")
    e, two = F.col("exposure"), F.col("funds") >= 2
    sums = x.groupBy("account", "total", "x.kind", "x.key").agg(F.sum("x.v").alias("exposure"), F.count(F.lit(1)).alias("funds"))
    near = e * (1 + 1e-9) + 1e-9
    sums = written(sums.where(((F.col("kind") == 1) & (e >= 0.2)) | ((F.col("kind") == 0) & ((two & (near >= 0.02)) | (near >= 0.05)))), "reached")

    level = lambda risk: F.when(e >= risk, "risk").otherwise("warning")
    told = sums.where("kind = 1").join(names, F.col("key") == F.col("id")).select("account", F.lit("industry").alias("kind"), F.col("industry").cast("string").alias("subject"), level(0.35).alias("level"), "exposure", "funds")
    wanted = sums.where("kind = 0").groupBy(F.col("account").alias("of"), "total").agg(F.collect_set("key").alias("keys"))
    some = p.join(wanted, F.col("account").eqNullSafe(F.col("of"))).select("account", "fund", "keys", (F.col("value") / F.col("total")).alias("w"))
    held = some.join(funds.select("fund", "stock_s", "stock_v"), "fund").withColumn("x", F.arrays_zip("stock_s", "stock_v"))
    own = F.filter("x", lambda y: F.array_contains("keys", bucket(y["stock_s"])))
    held = held.select("account", "w", F.explode_outer(own).alias("x")).where("x is not null")
    exact = held.groupBy("account", F.col("x.stock_s").cast("string").alias("subject")).agg(F.sum(F.col("w") * F.col("x.stock_v")).alias("exposure"), F.count(F.lit(1)).alias("funds"))
    direct = F.when(e >= 0.05, F.struct(F.lit("stock_exposure").alias("kind"), level(0.10).alias("level")))
    shared = F.when(two & (e >= 0.02), F.struct(F.lit("overlap").alias("kind"), F.lit("warning").alias("level")))
    exact = exact.select("account", "subject", "exposure", "funds", F.explode(F.array_compact(F.array(direct, shared))).alias("s"))
    return exact.select("account", "s.kind", "subject", "s.level", "exposure", "funds").unionByName(told)


def index_signals(quotes: DataFrame, weights: DataFrame, least: int = 21) -> DataFrame:
    """Of each index (code, market, trade_date, close) with ``least`` days: its move over 20 and 60 days, its deepest fall, the portfolio's weight of the market
    (market, weight), and a level: risk or warning after a fall of 5 % (risk: of 10 % with a weight of 0.3 or more), info after a rise of 5 %."""
    w = Window.partitionBy("code").orderBy("trade_date")
    back = lambda n: F.col("close") / F.lag("close", n).over(w) - 1
    x = quotes.where("close > 0").withColumns({"m20": back(20), "m60": back(60), "dd": F.col("close") / F.max("close").over(w) - 1})
    g = x.groupBy("code", "market").agg(F.count(F.lit(1)).alias("days"), F.max("trade_date").alias("last"), F.max_by("m20", "trade_date").alias("return_20d"), F.max_by("m60", "trade_date").alias("return_60d"), F.min("dd").alias("max_drawdown"))
    share = weights.groupBy("market").agg(F.sum("weight").alias("exposure"))
    j = g.where(F.col("days") >= least).join(share, "market", "left").withColumn("exposure", F.coalesce("exposure", F.lit(0.0)))
    m = F.col("return_20d")
    level = F.when((m <= -0.10) & (F.col("exposure") >= 0.3), "risk").when(m <= -0.05, "warning").when(m >= 0.05, "info")
    return j.withColumn("level", level)


def trailing_dividend(events: DataFrame, price: DataFrame, at: str, days: int = 365) -> DataFrame:
    """Cash of the newest revisions with an ex day in the window over the price; an uncovered source gives null, not 0. (code, ex_date, revision, available_at, cash)."""
    known = events.where((F.col("available_at") <= at) & (F.col("ex_date") <= at) & (F.col("ex_date") > F.date_sub(F.lit(at).cast("date"), days)))
    cash = newest(known, ["code", "ex_date"], [F.desc("revision")]).groupBy("code").agg(F.sum("cash").alias("cash"), F.count(F.lit(1)).alias("events"))
    j = price.join(cash, "code", "left")
    return j.select("code", F.when(~F.col("covered"), "source_not_covered").when(F.col("cash").isNull(), "no_dividend").otherwise("ok").alias("status"), F.when(F.col("covered"), F.coalesce("cash", F.lit(0.0)) / F.col("price")).alias("yield"))


def style_benchmark(panel: DataFrame, style: str, cost: float = 0.001) -> DataFrame:
    """Each period the mean forward return of the top fifth by style (at least one) less cost."""
    w = Window.partitionBy("month")
    x = panel.where(F.col(style).isNotNull() & F.col("fwd").isNotNull()).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc(style), "code")))
    return x.where(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") / 5))).groupBy("month").agg((F.avg("fwd") - cost).alias("ret"))


def equal_weight_curve(df: DataFrame) -> DataFrame:
    """Mean of price over first price by day (buy and hold)."""
    base = F.first("close").over(Window.partitionBy("code").orderBy("trade_date"))
    return df.withColumn("rel", F.col("close") / base).groupBy("trade_date").agg(F.avg("rel").alias("curve"), F.count(F.lit(1)).alias("n"))


def portfolio_returns(weights: DataFrame, rets: DataFrame) -> DataFrame:
    """Weighted mean return by day with fixed weights; a fund without a return that day counts as 0, one without any leaves the denominator."""
    have = weights.join(rets.select("code").distinct(), "code", "left_semi")
    total = have.agg(F.sum("weight").alias("total"))
    j = rets.join(have, "code").groupBy("trade_date").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("s"))
    return j.crossJoin(F.broadcast(total)).select("trade_date", (F.col("s") / F.col("total")).alias("ret"))


def neighborhood(df: DataFrame, by: str, value: str, center: Column) -> DataFrame:
    """The centre's share below among all (ties with others half), and the band without one smallest and one largest value (of fewer than three: all)."""
    w = Window.partitionBy(by)
    x = df.withColumn("c", F.max(F.when(center, F.col(value))).over(w)).withColumn("a", F.row_number().over(w.orderBy(value, "code"))).withColumn("b", F.row_number().over(w.orderBy(F.desc(value), F.desc("code"))))
    inner = ((F.col("a") > 1) & (F.col("b") > 1)) | (F.col("a") + F.col("b") <= 3)
    return x.groupBy(by).agg(((F.sum((F.col(value) < F.col("c")).cast("int")) + (F.sum((F.col(value) == F.col("c")).cast("int")) - 1) / 2) / F.count(F.lit(1))).alias("share"), F.min(F.when(inner, F.col(value))).alias("low"), F.max(F.when(inner, F.col(value))).alias("high"))


def predictiveness(panel: DataFrame, fold: Column) -> DataFrame:
    """fold, periods, mean_ic and q1 to q5: mean rank IC and mean forward return of each fifth by score (ties by code). Months without different returns are left out."""
    from tidemark.operators.evidence import rank_ic

    x = panel.where("score is not null and fwd is not null")
    some = x.groupBy("month").agg(F.max("fwd").alias("high"), F.min("fwd").alias("low")).where("high > low").select("month")
    ic = rank_ic(x).join(some, "month", "left_semi").groupBy(fold.alias("fold")).agg(F.count(F.lit(1)).alias("periods"), F.avg("ic").alias("mean_ic"))
    fifths = x.join(some, "month", "left_semi").withColumn("t", F.ntile(5).over(Window.partitionBy("month").orderBy("score", "code"))).groupBy("month", "t").agg(F.avg("fwd").alias("m"))
    q = fifths.groupBy(fold.alias("fold")).agg(*[F.avg(F.when(F.col("t") == i, F.col("m"))).alias(f"q{i}") for i in range(1, 6)])
    return ic.join(q, "fold")


def group_slices(panel: DataFrame, groups: list[str], share: float = 0.2) -> DataFrame:
    """slice (group:label), periods, log_excess and mean_rank_ic: the best ``share`` of each slice by score (one at least) against all names' mean, compounded over
    months, and the slice's mean rank IC over months with three names or more."""
    from tidemark.operators.evidence import rank_ic

    x = panel.where("score is not null and fwd is not null")
    mean = x.groupBy("month").agg(F.avg("fwd").alias("all"))
    labels = F.explode(F.array(*[F.concat(F.lit(f"{g}:"), F.col(g)) for g in groups])).alias("slice")
    x = x.select("month", "code", "score", "fwd", labels).where("slice is not null")
    w = Window.partitionBy("month", "slice")
    top = x.withColumn("k", F.row_number().over(w.orderBy(F.desc("score"), F.desc("code")))).withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("k") <= F.greatest(F.lit(1), F.ceil(F.col("n") * share)))
    excess = top.groupBy("month", "slice").agg(F.avg("fwd").alias("m")).join(mean, "month").withColumn("e", F.log(F.greatest(F.lit(1e-6), 1 + F.col("m") - F.col("all"))))
    ic = rank_ic(x.select(F.struct("month", "slice").alias("month"), "score", "fwd"), 3).select("month.slice", "ic").groupBy("slice").agg(F.avg(F.when(~F.isnan("ic"), F.col("ic"))).alias("mean_rank_ic"))
    return excess.groupBy("slice").agg(F.count(F.lit(1)).alias("periods"), F.sum("e").alias("log_excess")).join(ic, "slice", "left")


def decayed_weights(ic: DataFrame, at: str, half_life: float = 6.0, prior: float = 12.0, least: float = 0.05, most: float = 0.6) -> DataFrame:
    """Factor weights from information coefficients known before ``at``, decayed by age and shrunk to equal weights, within bounds."""
    age = F.row_number().over(Window.partitionBy("factor").orderBy(F.desc("month"))) - 1
    x = ic.where(F.col("month") < at).withColumn("w", F.pow(F.lit(2.0), -age / half_life))
    g = x.groupBy("factor").agg((F.sum(F.col("w") * F.col("ic")) / F.sum("w")).alias("mean"), F.sum("w").alias("mass"))
    all_ = Window.partitionBy(F.lit(1))
    pos = F.greatest(F.col("mean") * F.col("mass") / (F.col("mass") + prior), F.lit(0.0))
    raw = g.withColumn("pos", pos).withColumn("w", F.when(F.sum("pos").over(all_) > 0, F.col("pos") / F.sum("pos").over(all_)).otherwise(1 / F.count(F.lit(1)).over(all_)))
    c = raw.withColumn("w", F.greatest(F.lit(least), F.least(F.lit(most), "w")))
    return c.select("factor", "mean", (F.col("w") / F.sum("w").over(all_)).alias("weight"))


def latest_chain(signal: DataFrame, factor: DataFrame, files: DataFrame) -> DataFrame:
    """Signal -> factor -> newest source file, nested. (signal, factor), (factor, field), (field, file, seq)."""
    last = newest(files, ["field"], [F.desc("seq")]).drop("seq")
    j = signal.join(factor, "factor").join(last, "field")
    return j.groupBy("signal").agg(F.sort_array(F.collect_set(F.struct("factor", "field", "file"))).alias("chain"))
