"""Queries of streaming jobs and news events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import text_events as T
from tidemark.plans.base import NEWS, REVISIONS, news, r6, revisions, table
from tidemark.plans.relational import POSITIONS, positions
from tidemark.operators import series as S
from tidemark.sources import lake as L
from tidemark.streaming import books as B
from tidemark.streaming import jobs as J

QUERIES: dict = {}
ORACLES: dict = {}


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def shared(spark) -> str:
    return L.scratch(spark, "stream")


def events(spark, d):
    return J.stream(spark, f"{d}/events.parquet")


def first_line(col: str):
    return F.trim(F.coalesce(F.col(col), F.lit("")))


@q("st_dedup_news", f"WITH {NEWS}, h AS (SELECT news_id, source, trim(title) AS title, sha256(coalesce(source, '') || chr(0) || trim(coalesce(title, '')) || chr(0) || coalesce(lang, '')) AS content_hash FROM news WHERE news_id IS NOT NULL) SELECT content_hash, min(news_id) AS news_id, arg_min(source, news_id) AS source, arg_min(title, news_id) AS title FROM h GROUP BY 1")
def _(spark, d):
    """A feed that brings two thirds of the items, then all of them again: each content once, under its first item."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    n = news(spark, d).where("news_id is not null").select("news_id", "source", F.trim("title").alias("title"), F.sha2(F.concat(text("source"), F.lit("\0"), first_line("title"), F.lit("\0"), text("lang")), 256).alias("content_hash"))
    folder, root = L.scratch(spark, "feed"), shared(spark)
    early = n.where(F.col("news_id") <= n.agg(F.expr("max(news_id) * 2 div 3").alias("m")).first().m)
    return J.in_turns([early, n], folder, lambda: J.upsert_new(J.stream(spark, folder), root, "content_hash", "news_id")).select("content_hash", "news_id", "source", "title")


@q("st_tumbling_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def _(spark, d):
    x = J.run_to_table(J.tumbling(events(spark, d), "ts", "event_type", "value", "1 hour"), shared(spark), "update", ["start", "event_type"])
    return x.select("start", "event_type", "n", *r6("mean"))


@q("st_sliding_totals", "SELECT s.start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, LATERAL (SELECT date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS start FROM range(0, 7) r(k)) s GROUP BY 1, 2")
def _(spark, d):
    x = J.run_to_table(J.sliding(events(spark, d), "ts", "event_type", "value", "7 days", "1 day"), shared(spark), "update", ["start", "event_type"])
    return x.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@q("st_sliding_score", """WITH e AS (SELECT user_id, ts, value * CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS value, CASE WHEN event_type = 'error' THEN 30 WHEN event_type = 'purchase' THEN 14 ELSE 7 END AS h FROM events),
 steps AS (SELECT unnest(range(date_trunc('day', min(ts)) + INTERVAL 1 DAY, max(ts) - INTERVAL 2 HOUR + INTERVAL 1 SECOND, INTERVAL 1 DAY)) AS step FROM events)
 SELECT user_id, CAST(step AS DATE) AS step, round(sum(value * pow(0.5, epoch(step - ts) / 86400 / greatest(2.0, h / 2.0))), 4) AS score, count(*) AS events FROM steps JOIN e ON ts < step AND date_trunc('day', ts) + to_days(h) >= step GROUP BY 1, 2""")
def _(spark, d):
    """A user's events as news: purchases and others speak for it, errors against it; errors are heard for 30 days, purchases for 14, others for 7."""
    kind = F.col("event_type")
    e = events(spark, d).select("user_id", "ts", F.when(kind == "error", -F.col("value")).otherwise(F.col("value")).alias("score"), F.when(kind == "error", 30).when(kind == "purchase", 14).otherwise(7).alias("horizon"))
    B.keyed_state(spark)
    return J.run_to_table(B.decayed_scores(e, ["user_id"], "ts", "score", "horizon", "2 hours"), shared(spark), "append").select("user_id", "step", F.round("score", 4).alias("score"), "events")


@q("st_session_events", "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM x) SELECT min(ts) AS start, user_id, count(*) AS n FROM y GROUP BY user_id, g")
def _(spark, d):
    closed = J.run_to_table(J.sessions(events(spark, d), "ts", "user_id", "6 hours"), shared(spark), "append")
    rows = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return J.with_open_sessions(closed, rows, "ts", "user_id", "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


#: Revisions come in three turns, by the day from which they are known; a 17th of each turn comes with the next one.
TURNS = ("1995-01-01", "1997-01-01")


@q("st_late_revisions", f"""WITH {REVISIONS}, t AS (SELECT *, CASE WHEN available_at < DATE '{TURNS[0]}' THEN 0 WHEN available_at < DATE '{TURNS[1]}' THEN 1 ELSE 2 END + CASE WHEN ingest_no % 17 = 0 THEN 1 ELSE 0 END AS turn FROM revisions),
 m AS (SELECT turn, max(available_at) AS top FROM t GROUP BY 1), l AS (SELECT t.*, coalesce(available_at < (SELECT max(top) FROM m WHERE m.turn < t.turn) - INTERVAL 30 DAY, false) AS late FROM t)
 SELECT code, effective_date, source, value, late, count(*) OVER (PARTITION BY late) AS alike FROM (SELECT *, row_number() OVER (PARTITION BY code, effective_date ORDER BY available_at DESC, ingest_no DESC) AS n FROM l WHERE available_at <= DATE '1999-06-30') WHERE n = 1""")
def _(spark, d):
    """Newest revision known by a day, whether it came behind the watermark, and how many of the newest did alike."""
    r, day = revisions(spark, d), F.col("available_at")
    r = r.withColumn("turn", F.when(day < TURNS[0], 0).when(day < TURNS[1], 1).otherwise(2) + (F.col("ingest_no") % 17 == 0).cast("int"))
    r, folder, root = L.written(r, "revisions"), L.scratch(spark, "arrivals"), shared(spark)
    got = J.in_turns([r.where(F.col("turn") == i).drop("turn") for i in range(4)], folder, lambda: J.split_late(J.stream(spark, folder), root, "available_at", "30 days"))
    last = S.latest_version(got.where("available_at <= '1999-06-30'"), ["code", "effective_date"], ["available_at", "ingest_no"])
    alike = last.groupBy("late").agg(F.count(F.lit(1)).alias("alike"))
    return last.join(alike, "late").select("code", "effective_date", "source", "value", "late", "alike")


#: Seconds after which a feed without news is overdue.
SLA = {"view": 3_600, "click": 7_200, "signup": 43_200, "purchase": 45_000, "error": 86_400}


@q("st_feed_freshness", f"SELECT event_type, allowed, max(ts) AS last_at, date_diff('second', max(ts), TIMESTAMP '2024-01-31 12:00:00') > allowed AS overdue FROM events JOIN (VALUES {', '.join(f"('{k}', {v})" for k, v in SLA.items())}) p(event_type, allowed) USING (event_type) GROUP BY 1, 2")
def _(spark, d):
    policy = spark.createDataFrame(list(SLA.items()), "event_type string, limit int")
    x = J.run_to_table(J.freshness(events(spark, d), policy, "event_type", "ts"), shared(spark), "update", ["event_type", "limit"])
    lag = F.unix_timestamp(F.lit("2024-01-31 12:00:00")) - F.unix_timestamp("last_at")
    return x.select("event_type", F.col("limit").alias("allowed"), F.col("last_at").cast("timestamp_ntz").alias("last_at"), (lag > F.col("limit")).alias("overdue"))


ORDER_KINDS = ["submitted", "acknowledged", "partially_filled", "cancel_requested", "cancel_rejected", "note", "fill_cancelled", "filled", "cancelled", "rejected"]
ORDER_SQL = f"""oe AS (SELECT CAST(user_id AS VARCHAR) || '-' || (event_id // 1000) AS order_id, event_id AS sequence, CASE WHEN event_id % 4 <> 0 THEN event_id * 7919 % 100003 END AS broker, CASE WHEN event_id % 29 = 0 THEN 7 + event_id % 3 ELSE event_id % 7 END AS k FROM events),
 os AS (SELECT order_id, sequence, coalesce(broker, sequence + 1000000000000) AS place, CASE WHEN k = 7 THEN 'filled' WHEN k = 8 THEN 'cancelled' WHEN k = 9 THEN 'rejected' WHEN k = 0 THEN 'submitted' WHEN k IN (1, 4, 6) THEN 'accepted' WHEN k = 2 THEN 'partially_filled' WHEN k = 3 THEN 'cancel_pending' END AS status, k >= 7 AS terminal FROM oe)"""


def order_log(spark, d):
    """Events of orders in the broker's numbering, which is out of order, or without a number of it."""
    i = F.col("event_id")
    k = F.when(i % 29 == 0, 7 + i % 3).otherwise(i % 7)
    kinds = F.array(*[F.lit(x) for x in ORDER_KINDS])
    order = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor(i / 1000).cast("string"))
    return table(spark, d, "events").select(order.alias("order_id"), i.alias("sequence"), F.when(i % 4 != 0, i * 7919 % 100003).alias("broker_sequence"), F.get(kinds, k.cast("int")).alias("event_type"), F.concat(F.lit("x"), i.cast("string")).alias("external_id"))


@q("st_order_events", f"WITH {ORDER_SQL} SELECT o.order_id, coalesce(l.status, 'created') AS status, o.events FROM (SELECT order_id, count(*) AS events FROM os GROUP BY 1) o LEFT JOIN (SELECT order_id, status FROM os WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY terminal DESC, place DESC, sequence DESC) = 1) l USING (order_id)")
def _(spark, d):
    """The log comes in two turns, the second of which brings all of it again."""
    B.keyed_state(spark)
    x = order_log(spark, d)
    folder, root = L.scratch(spark, "feed"), shared(spark)
    run = lambda: J.run_to_table(B.order_stream(J.stream(spark, folder), ["order_id"], ["external_id"]), root, "append", ["order_id"])
    return J.in_turns([x.where("sequence % 3 <> 1"), x], folder, run)


@q("order_states_batch", f"WITH {ORDER_SQL} SELECT o.order_id, coalesce(l.status, 'created') AS status, o.events FROM (SELECT order_id, count(*) AS events FROM os GROUP BY 1) o LEFT JOIN (SELECT order_id, status FROM os WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY terminal DESC, place DESC, sequence DESC) = 1) l USING (order_id)")
def _(spark, d):
    return B.order_states(order_log(spark, d), ["order_id"], ["external_id"])


@q("st_chain_verify", """SELECT day, min(b) AS first_break FROM (SELECT CAST(ts AS DATE) AS day, CASE WHEN event_id % 89 = 0 THEN event_id WHEN lag(event_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) % 97 = 0 AND lag(event_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) % 89 <> 0 THEN event_id END AS b FROM events)
 WHERE b IS NOT NULL GROUP BY 1""")
def _(spark, d):
    """One chain a day. Some payloads are changed (a break at the row); others are changed and hashed again (a break at the row after)."""
    c = J.chain(table(spark, d, "events").select(F.to_date("ts").alias("day"), "event_id", "props"), "day", "event_id", "props")
    changed, again = F.col("event_id") % 89 == 0, (F.col("event_id") % 97 == 0) & (F.col("event_id") % 89 != 0)
    c = c.withColumn("props", F.when(changed | again, F.concat("props", F.lit(" "))).otherwise(F.col("props")))
    return J.first_break(c.withColumn("entry_hash", F.when(again, J.entry_hash("props")).otherwise(F.col("entry_hash"))), "day", "event_id", "props")


CASH = "cash AS (SELECT o_custkey AS account, l_returnflag AS bucket, CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice * (1 - l_discount)) AS delta, sum(CASE WHEN l_linenumber = 7 AND o_custkey % 5 = 0 THEN 0 ELSE l_extendedprice * (1 - l_discount) END) AS booked FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"


@q("st_cash_conservation", f"""WITH {CASH}, b AS (SELECT account, bucket, day, sum(booked) OVER (PARTITION BY account, bucket ORDER BY day) AS balance FROM cash), e AS (SELECT account, bucket, min(day) AS since, arg_min(balance, day) AS opening, arg_max(balance, day) AS closing FROM b GROUP BY 1, 2),
 t AS (SELECT account, bucket, sum(delta) AS total FROM cash JOIN e USING (account, bucket) WHERE day > since GROUP BY 1, 2)
 SELECT account, bucket, round(opening, 4) AS opening, round(closing, 4) AS closing, round(coalesce(total, 0), 4) AS total, abs(closing - opening - coalesce(total, 0)) <= 1e-4 AS ok FROM e LEFT JOIN t USING (account, bucket)""")
def _(spark, d):
    """Cash of each account by return flag; the stored balances of some accounts lack a line."""
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lost = (F.col("l_linenumber") == 7) & (F.col("o_custkey") % 5 == 0)
    days = j.groupBy(F.col("o_custkey").alias("account"), F.col("l_returnflag").alias("bucket"), F.to_date("l_shipdate").alias("day")).agg(F.sum(amount).alias("delta"), F.sum(F.when(lost, 0.0).otherwise(amount)).alias("booked"))
    balance = F.sum("booked").over(Window.partitionBy("account", "bucket").orderBy("day"))
    got = J.conservation(days, days.select("account", "bucket", "day", balance.alias("balance")), ["account", "bucket"], "day")
    return got.select("account", "bucket", *[F.round(c, 4).alias(c) for c in ("opening", "closing", "total")], "ok")


@q("st_reconcile", f"WITH {POSITIONS}, r AS (SELECT account, fund, shares + CASE WHEN fund % 10 = 0 THEN 1 ELSE 0 END AS shares FROM positions WHERE fund % 7 <> 0) SELECT coalesce(p.account, r.account) AS account, coalesce(p.fund, r.fund) AS fund, CASE WHEN p.shares IS NULL THEN 'missing_local' WHEN r.shares IS NULL THEN 'missing_remote' ELSE 'difference' END AS kind FROM (SELECT * FROM positions WHERE fund % 11 <> 0) p FULL JOIN r ON p.account = r.account AND p.fund = r.fund WHERE p.shares IS NULL OR r.shares IS NULL OR abs(p.shares - r.shares) > 0.5")
def _(spark, d):
    # Written, as both sides are taken from it: a task then sums positions or sorts a side, not all at once.
    p = L.written(positions(spark, d).select("account", "fund", "shares"), "positions")
    remote = p.where("fund % 7 <> 0").withColumn("shares", F.col("shares") + F.when(F.col("fund") % 10 == 0, 1.0).otherwise(0.0))
    return J.reconcile(p.where("fund % 11 <> 0"), remote, ["account", "fund"], "shares", 0.5)


TRADE = """line AS (SELECT o_custkey AS account, l_suppkey % 3 AS code, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS event_id, CAST(l_shipdate AS DATE) AS day,
  CASE WHEN l_linenumber = 6 THEN CASE WHEN l_orderkey % 4 = 0 THEN 'split' WHEN l_orderkey % 4 = 1 THEN 'rights' WHEN l_orderkey % 4 = 2 THEN 'tax' WHEN l_orderkey % 8 = 3 THEN 'record' ELSE 'dividend' END WHEN l_linenumber = 7 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'swap_in' ELSE 'swap_out' END WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS type,
  CASE WHEN l_linenumber = 6 THEN CASE WHEN l_orderkey % 4 = 0 THEN 2.0 ELSE 0.1 END ELSE l_quantity END AS quantity, l_extendedprice / l_quantity * CASE WHEN l_linenumber = 6 THEN 0.01 ELSE 1 END AS price, l_tax * 10 AS fee, CAST(NULL AS VARCHAR) AS ref, l_orderkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 trade AS (SELECT * FROM line UNION ALL SELECT account, code, event_id || 'p', day + 20, 'pay', 0, 0, 0, event_id, k FROM line WHERE type = 'record' AND k % 16 = 3)"""


def trades(spark, d):
    """Each line as an event of its account and one of three instruments: trades, and of some line numbers splits, rights, tax, dividends and swaps. Half
    of the recorded dividends are paid 20 days later. A hundredth of the orders come twice."""
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    line, key = F.col("l_linenumber"), F.col("l_orderkey")
    other = F.when(key % 4 == 0, "split").when(key % 4 == 1, "rights").when(key % 4 == 2, "tax").when(key % 8 == 3, "record").otherwise("dividend")
    kind = F.when(line == 6, other).when(line == 7, F.when(key % 2 == 0, "swap_in").otherwise("swap_out")).when(F.col("l_returnflag") == "R", "sell").otherwise("buy")
    quantity = F.when(line == 6, F.when(key % 4 == 0, 2.0).otherwise(0.1)).otherwise(F.col("l_quantity"))
    price = F.col("l_extendedprice") / F.col("l_quantity") * F.when(line == 6, 0.01).otherwise(1.0)
    x = j.select(
        F.col("o_custkey").alias("account"), (F.col("l_suppkey") % 3).alias("code"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("event_id"), F.to_date("l_shipdate").alias("day"),
        kind.alias("type"), quantity.alias("quantity"), price.alias("price"), (F.col("l_tax") * 10).alias("fee"), F.lit(None).cast("string").alias("ref"), key.alias("k"),
    )
    none = F.lit(0.0)
    paid = x.where("type = 'record' and k % 16 = 3").select("account", "code", F.concat("event_id", F.lit("p")).alias("event_id"), F.date_add("day", 20).alias("day"), F.lit("pay").alias("type"), none.alias("quantity"), none.alias("price"), none.alias("fee"), F.col("event_id").alias("ref"), "k")
    return x.unionByName(paid).unionByName(x.where("k % 100 = 0")).drop("k")


LEDGER = f"""WITH RECURSIVE {TRADE}, n AS (SELECT *, row_number() OVER (PARTITION BY account, code ORDER BY day, event_id) AS i FROM trade),
 f AS (SELECT account, code, 0::BIGINT AS i, NULL::VARCHAR AS id, NULL::VARCHAR AS ref, 0e0 AS held, 1e4::DOUBLE AS cash, 0e0 AS fees, 0e0 AS mark, NULL::DOUBLE AS amount FROM n GROUP BY 1, 2
  UNION ALL SELECT n.account, n.code, n.i, n.event_id, n.ref, CASE type WHEN 'buy' THEN held + quantity WHEN 'swap_in' THEN held + quantity WHEN 'sell' THEN greatest(held - quantity, 0) WHEN 'swap_out' THEN greatest(held - quantity, 0) WHEN 'split' THEN held * quantity WHEN 'rights' THEN held * (1 + quantity) ELSE held END,
   cash + CASE type WHEN 'buy' THEN -quantity * price - fee WHEN 'sell' THEN least(held, quantity) * price - fee WHEN 'dividend' THEN held * price WHEN 'tax' THEN -held * price WHEN 'rights' THEN -held * quantity * price ELSE 0 END, fees + CASE WHEN type IN ('buy', 'sell') THEN fee ELSE 0 END,
   CASE WHEN type IN ('buy', 'sell') THEN price WHEN type = 'split' THEN mark / quantity ELSE mark END, CASE WHEN type = 'record' THEN held * price END
  FROM f JOIN n ON n.account = f.account AND n.code = f.code AND n.i = f.i + 1),
 r AS (SELECT a.account, a.code, sum(CASE WHEN b.ref IS NULL THEN 0 ELSE a.amount END) AS got, sum(CASE WHEN b.ref IS NULL THEN a.amount ELSE 0 END) AS due FROM f a LEFT JOIN f b ON b.ref = a.id AND b.account = a.account AND b.code = a.code WHERE a.amount IS NOT NULL GROUP BY 1, 2),
 t AS (SELECT account, code, arg_max(cash, i) AS cash, arg_max(held, i) AS held, arg_max(fees, i) AS fees, arg_max(mark, i) AS mark, max(i) AS events FROM f GROUP BY 1, 2)
 SELECT account, code, round(cash + coalesce(got, 0), 4) AS cash, round(held, 4) AS held, round(fees, 4) AS fees, events, round(coalesce(due, 0), 4) AS receivable, round(cash + coalesce(got, 0) + held * mark + coalesce(due, 0), 4) AS nav FROM t LEFT JOIN r USING (account, code)"""


def booked(df):
    return df.select("account", "code", *[F.round(c, 4).alias(c) for c in ("cash", "held", "fees")], "events", *[F.round(c, 4).alias(c) for c in ("receivable", "nav")])


#: Events come in three turns, each a run of the stream that goes on from the checkpoint of the one before.
DAYS = ("1994-07-01", "1997-01-01")


def event_turns(df):
    df, (a, b) = L.written(df, "events"), DAYS
    return [df.where(F.col("day") < a), df.where(f"day >= '{a}' and day < '{b}'"), df.where(F.col("day") >= b)]


@q("st_ledger_replay", LEDGER)
def _(spark, d):
    B.keyed_state(spark)
    folder, root, by = L.scratch(spark, "ledger"), shared(spark), ["account", "code"]
    book = lambda e: B.ledger_stream(e.withColumn("book", F.col("code")).withColumn("code", F.col("code").cast("string")), ["account", "book"], ["day", "event_id"], 10000.0)
    got = J.in_turns(event_turns(trades(spark, d)), folder, lambda: J.run_to_table(book(J.stream(spark, folder)), root, "append", ["account", "book"]))
    return booked(got.withColumnRenamed("book", by[1]))


@q("ledger_replay_batch", LEDGER)
def _(spark, d):
    return booked(J.replay_ledger(trades(spark, d), ["account", "code"], ["day", "event_id"], 10000.0))


LOTS = f"""WITH RECURSIVE {TRADE}, t AS (SELECT * FROM trade WHERE type IN ('buy', 'sell')), n AS (SELECT *, row_number() OVER (PARTITION BY account, code ORDER BY day, event_id) AS i FROM t),
 f AS (SELECT account, code, 0::BIGINT AS i, 0e0 AS held FROM n GROUP BY 1, 2 UNION ALL SELECT n.account, n.code, n.i, CASE type WHEN 'buy' THEN held + quantity ELSE greatest(held - quantity, 0) END FROM f JOIN n ON n.account = f.account AND n.code = f.code AND n.i = f.i + 1),
 h AS (SELECT account, code, arg_max(held, i) AS held FROM f GROUP BY 1, 2), b AS (SELECT *, sum(quantity) OVER (PARTITION BY account, code ORDER BY i DESC) - quantity AS newer FROM n WHERE type = 'buy')
 SELECT b.account, b.code, day AS acquired, round(least(quantity, held - newer), 4) AS quantity, day + 1 AS sellable FROM b JOIN h ON h.account = b.account AND h.code = b.code WHERE held - newer > 1e-9"""


@q("st_lots", LOTS)
def _(spark, d):
    B.keyed_state(spark)
    folder, root, by = L.scratch(spark, "lots"), shared(spark), ["account", "code"]
    run = lambda: J.run_to_table(B.lots_stream(J.stream(spark, folder), by, ["day", "event_id"]), root, "append", [*by, "lot"])
    got = J.in_turns(event_turns(trades(spark, d).where("type in ('buy', 'sell')")), folder, run)
    return got.where("quantity > 0").select("account", "code", "acquired", F.round("quantity", 4).alias("quantity"), "sellable")


@q("lots_batch", LOTS)
def _(spark, d):
    return J.fifo_lots(trades(spark, d).where("type in ('buy', 'sell')"), ["account", "code"], ["day", "event_id"]).select("account", "code", "acquired", F.round("quantity", 4).alias("quantity"), "sellable")


@q("st_membership_replay", "WITH e AS (SELECT o_orderstatus AS grp, o_custkey AS code, CAST(o_orderdate AS DATE) AS d, o_orderkey AS no, CASE WHEN o_orderkey % 3 = 0 THEN 'remove' ELSE 'add' END AS t FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-02') SELECT grp, code FROM e GROUP BY 1, 2 HAVING arg_max(t, (d, no)) = 'add'")
def _(spark, d):
    e = table(spark, d, "orders").select(F.col("o_orderstatus").alias("grp"), F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("event_no"), F.when(F.col("o_orderkey") % 3 == 0, "remove").otherwise("add").alias("event_type"))
    return J.members_at(e, "grp", "code", "day", "1999-01-01")


@q("join_fuzzy_titles")
def _(spark, d):
    return T.similar_pairs(news(spark, d))


@q("join_cluster_events")
def _(spark, d):
    from tidemark.functions.rules import source_quality

    n = news(spark, d).withColumn("quality", source_quality(F.col("source")))
    return T.cluster_events(n, T.similar_pairs(n))


@q("join_keyword_table", "SELECT DISTINCT code, keyword FROM (SELECT s_suppkey AS code, s_name AS keyword FROM supplier UNION ALL SELECT s_suppkey, regexp_replace(s_name, '[#\\s]*\\d+$', '') FROM supplier UNION ALL SELECT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE keyword <> ''")
def _(spark, d):
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))
    held = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("code"), F.col("p_brand").alias("item"))
    return T.keyword_table(names, held)


def named(kind: str, col):
    """A target of one kind as text, so that keys of different tables stay apart."""
    return F.concat(F.lit(f"{kind}:"), F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


EXPOSURE = """WITH lines AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2), brands AS (SELECT p_brand, l_suppkey, sum(quantity) AS quantity FROM lines JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
 held AS (SELECT l_suppkey, sum(quantity) AS total FROM brands GROUP BY 1),
 paths(path, target, fund, exposure) AS (SELECT 'holding', 'part:' || l_partkey, l_suppkey, quantity / 1000 FROM lines UNION ALL SELECT 'direct', 'fund:' || s_suppkey, s_suppkey, 1.0 FROM supplier UNION ALL SELECT 'market', 'region:' || n_regionkey, s_suppkey, 1.0 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'benchmark', 'nation:' || s_nationkey, s_suppkey, 1.0 FROM supplier UNION ALL SELECT 'industry', 'brand:' || p_brand, l_suppkey, quantity / total FROM brands JOIN held USING (l_suppkey)),
 k AS (SELECT p_partkey % 2000 AS k, min(p_brand) AS brand FROM part GROUP BY 1), e AS (SELECT event_id, event_type, event_id % 2000 AS k, brand, 0.5 + (event_id % 5) / 10.0 AS r FROM events LEFT JOIN k ON event_id % 2000 = k),
 t(event, target, relevance) AS (SELECT event_id, 'part:' || k, 0.9 * r FROM e UNION ALL SELECT event_id, 'fund:' || k, r FROM e UNION ALL SELECT event_id, 'region:' || event_id % 5, 0.78 * r FROM e WHERE event_type = 'signup'
  UNION ALL SELECT event_id, 'nation:' || event_id % 25, 0.88 * r FROM e WHERE event_type = 'error' UNION ALL SELECT event_id, 'brand:' || brand, 0.76 * r FROM e WHERE event_type = 'purchase' AND brand IS NOT NULL),
 f AS (SELECT event, fund, path, max(relevance) * CASE WHEN path = 'holding' THEN least(1.0, sum(exposure)) ELSE max(exposure) END AS strength FROM t JOIN paths USING (target) GROUP BY 1, 2, 3)
 SELECT event, fund, arg_max(path, (strength, path)) AS path, round(max(strength), 6) AS strength FROM f GROUP BY 1, 2"""


@q("join_event_exposure", EXPOSURE)
def _(spark, d):
    """All events by all five paths, each with its relevance. An event names a part, a supplier and, by its type, a region,
    a nation or a brand; a supplier's share of a brand is its exposure to that industry."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    lines = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"))
    brands = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"))
    brands = L.written(brands, "brands")
    held = brands.groupBy("l_suppkey").agg(F.sum("quantity").alias("total"))
    fund = lambda df, target, key, exposure: df.select(target.alias("target"), F.col(key).alias("fund"), exposure.alias("exposure"))
    paths = [
        ("holding", fund(lines, named("part", "l_partkey"), "l_suppkey", F.col("quantity") / 1000), True),
        ("direct", fund(s, named("fund", "s_suppkey"), "s_suppkey", F.lit(1.0)), False),
        ("market", fund(s.join(n, s.s_nationkey == n.n_nationkey), named("region", "n_regionkey"), "s_suppkey", F.lit(1.0)), False),
        ("benchmark", fund(s, named("nation", "s_nationkey"), "s_suppkey", F.lit(1.0)), False),
        ("industry", fund(brands.join(held, "l_suppkey"), named("brand", "p_brand"), "l_suppkey", F.col("quantity") / F.col("total")), False),
    ]
    e, kind = table(spark, d, "events"), F.col("event_type")
    part = table(spark, d, "part").select((F.col("p_partkey") % 2000).alias("k"), "p_brand").groupBy("k").agg(F.min("p_brand").alias("brand"))
    e = e.withColumn("k", F.col("event_id") % 2000).join(part, "k", "left")
    at = lambda relevance, target: F.struct(target.alias("target"), (F.lit(relevance) * (0.5 + (F.col("event_id") % 5) / 10)).alias("relevance"))
    wide = F.when(kind == "signup", at(0.78, named("region", F.col("event_id") % 5))).when(kind == "error", at(0.88, named("nation", F.col("event_id") % 25))).when(kind == "purchase", at(0.76, named("brand", "brand")))
    t = e.select(F.col("event_id").alias("event"), F.explode(F.array(at(0.9, named("part", "k")), at(1.0, named("fund", "k")), wide)).alias("x")).select("event", "x.target", "x.relevance").where("target is not null")
    return T.event_exposure(t, paths, digits=6)
