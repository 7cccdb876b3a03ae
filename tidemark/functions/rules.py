"""Scalar rules as Column expressions: codes, titles, fees, prices, periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in headlines.
BUZZ = ["breaking", "update", "exclusive", "live"]


def normalize_title(x: Column) -> Column:
    """Without tags, leading [..], buzz words and other than letters and digits; lower case, 240 characters."""
    x = F.regexp_replace(x, "<[^>]*>", " ")
    x = F.regexp_replace(x, r"^\s*\[[^\]]*\]", " ")
    x = F.lower(x)
    x = F.regexp_replace(x, rf"\b({'|'.join(BUZZ)})\b", " ")
    return F.substring(F.trim(F.regexp_replace(x, r"[^a-z0-9]+", " ")), 1, 240)


def title_key(x: Column) -> Column:
    return F.sha2(normalize_title(x), 256)


def first_keyword(x: Column, rules: list[tuple[str, list[str]]], other: str) -> Column:
    """Label of the first rule in order of which a keyword is in the text."""
    out = F.lit(other)
    for label, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | x.contains(w)
        out = F.when(hit, label).otherwise(out)
    return out


def family_share(name: Column) -> tuple[Column, Column]:
    """Family and share class: a single capital at the end is the class."""
    share = F.regexp_extract(name, r"\s*([A-Z])$", 1)
    return F.trim(F.regexp_replace(name, r"\s*[A-Z]$", "")), F.when(share == "", None).otherwise(share)


def board(code: Column) -> Column:
    """Board by the code's prefix."""
    return F.when(code.startswith("688"), "star").when(code.startswith("30"), "growth").when(code.startswith("6"), "main_sh").when(code.startswith("0"), "main_sz").when(code.startswith("8") | code.startswith("4"), "bj").otherwise("other")


def price_limit(board: Column, st: Column) -> Column:
    return F.when(st, 0.05).when(board.isin("star", "growth"), 0.2).when(board == "bj", 0.3).otherwise(0.1)


def host_quality(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:]+)", 1))
    return F.when(host.rlike(r"(^|\.)gov\."), 1.0).when(host.endswith(".com"), 0.8).when(host == "", 0.3).otherwise(0.6)


def source_quality(source: Column) -> Column:
    """Quality of a news source by its name: official ones 1, agencies and the press 0.72, others 0.5."""
    name = F.lower(F.coalesce(source, F.lit("")))
    return F.when(name.rlike("gov|official|exchange"), 1.0).when(name.rlike("news|wire|press"), 0.72).otherwise(0.5)


def disclosure_deadline(period: Column) -> Column:
    """Latest legal disclosure date of a quarter end: end of April, August, October; annual: end of the next April."""
    y, m = F.year(period), F.month(period)
    return F.when(m == 3, F.make_date(y, F.lit(4), F.lit(30))).when(m == 6, F.make_date(y, F.lit(8), F.lit(31))).when(m == 9, F.make_date(y, F.lit(10), F.lit(31))).when(m == 12, F.make_date(y + 1, F.lit(4), F.lit(30)))


def window_start(window: str, end: Column) -> Column:
    return {"1d": F.date_sub(end, 1), "1w": F.date_sub(end, 7), "1m": F.add_months(end, -1), "3m": F.add_months(end, -3)}[window]


def round_tick(x: Column) -> Column:
    """Half up to the cent, on the decimal text of the value."""
    return F.round(x.cast("decimal(20,6)"), 2)


def fee(amount: Column, sell: Column, commission: float = 0.00025, minimum: float = 5.0, stamp: float = 0.001, transfer: float = 0.00001) -> Column:
    """Commission with a minimum, stamp duty on sales, transfer fee."""
    return F.greatest(amount * commission, F.lit(minimum)) + F.when(sell, amount * stamp).otherwise(0.0) + amount * transfer


def slippage(participation: Column, vol: Column, base: float = 0.0005, k: float = 0.01, c: float = 0.05, most: float = 0.02) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(0.0), base + k * F.sqrt(F.greatest(participation, F.lit(0.0))) + c * vol))


def lot_quantity(shares: Column, board: Column, sell: Column, held: Column) -> Column:
    """Whole lots (star: at least 200, then single shares); a sale of all that is held may be odd."""
    lots = F.floor(shares / 100) * 100
    bought = F.when(board == "star", F.when(shares >= 200, F.floor(shares)).otherwise(0)).otherwise(lots)
    return F.when(sell & (shares >= held), held).otherwise(bought)


def cash_conversion(income: Column, cash: Column, assets: Column, floor: float) -> Column:
    """struct(accrual, ratio, kind): the ratio only for a profit above the floor."""
    kind = F.when(income.isNull() | cash.isNull() | assets.isNull(), "missing").when(income <= 0, "loss").when(income < floor, "small_profit").otherwise("ok")
    return F.struct(F.when(assets > 0, (cash - income) / assets).alias("accrual"), F.when(kind == "ok", cash / income).alias("ratio"), kind.alias("kind"))


def period_date(text: Column) -> Column:
    """2023Q1, 2023-H1, 2023 annual or a date text to the end of the period."""
    y = F.regexp_extract(text, r"(\d{4})", 1).cast("int")
    quarter = F.regexp_extract(text, r"[Qq]([1-4])", 1)
    month = F.when(quarter != "", F.expr("3") * F.when(quarter == "", 1).otherwise(quarter).cast("int")).when(text.rlike("[Hh]1"), 6).when(text.rlike(r"(?i)annual|[Hh]2"), 12)
    return F.last_day(F.make_date(y, month, F.lit(1)))


#: Fixed values of the order policy: days and attempts an order lives, what a signal loses per attempt and keeps at least, and the price move that cancels.
ORDER_DAYS, ORDER_ATTEMPTS, SIGNAL_LOSS, SIGNAL_LEAST, PRICE_MOVE = 5, 5, 0.10, 0.50, 0.15


def signal_strength(attempts: Column) -> Column:
    """What is left of a signal after some attempts to trade on it."""
    return F.greatest(F.lit(SIGNAL_LEAST), 1.0 - F.greatest(attempts, F.lit(0)) * SIGNAL_LOSS)


def decayed_weight(current: Column, target: Column, attempts: Column) -> Column:
    """The target weight drawn back to the current one as the signal ages."""
    return current + (target - current) * signal_strength(attempts)


def price_deviation(decision: Column, now: Column) -> Column:
    """Move since the decision; null without two prices above zero."""
    return F.when((decision > 0) & (now > 0), now / decision - 1.0)


def order_expired(attempts: Column, days: Column) -> Column:
    return (attempts >= ORDER_ATTEMPTS) | (days > ORDER_DAYS)


def opportunity_cost(side: Column, unfilled: Column, decision: Column, now: Column) -> Column:
    """What the unfilled part has cost: above zero where a purchase has become dearer or a sale cheaper; null without prices or unfilled shares."""
    sign = F.when(side == "buy", 1.0).otherwise(-1.0)
    return F.when(price_deviation(decision, now).isNotNull() & (unfilled > 0), sign * (now - decision) * unfilled)


#: Taxes on dividends by holding period: first day of the rule, its name, rates up to 30 days, up to 365 days and beyond. Fixed values.
DIVIDEND_TAX = [
    ("2013-01-01", "CN_LISTED_DIVIDEND_TAX_2013", 0.20, 0.10, 0.05),
    ("2015-09-08", "CN_LISTED_DIVIDEND_TAX_2015", 0.20, 0.10, 0.0),
]


def dividend_tax(acquired: Column, sold: Column, entitled: Column, shares: Column, cash: Column, withheld: Column) -> Column:
    """struct(days, rate, rule, tax) of a lot's shares that are sold: the rule is the one of the entitlement's day, the tax is not below zero after what was withheld
    at payment. Null before the first rule and where the sale lies before the purchase."""
    days = F.datediff(sold, acquired)
    rate, rule = F.lit(None).cast("double"), F.lit(None).cast("string")
    for first, name, month, year, beyond in DIVIDEND_TAX:
        since = entitled >= F.lit(first).cast("date")
        rate = F.when(since, F.when(days <= 30, month).when(days <= 365, year).otherwise(beyond)).otherwise(rate)
        rule = F.when(since, name).otherwise(rule)
    tax = F.greatest(shares * cash * rate - withheld, F.lit(0.0))
    return F.when((days >= 0) & rule.isNotNull(), F.struct(days.alias("days"), rate.alias("rate"), rule.alias("rule"), tax.alias("tax")))


def convert_shares(raw: Column, compensation: Column, increment: float = 1.0) -> Column:
    """struct(registered, fraction, cash, restricted): whole increments are registered, the rest is paid out where a compensation is known and restricted where not."""
    registered = F.floor(raw / increment + 1e-12) * increment
    left = F.greatest(raw - registered, F.lit(0.0))
    paid = compensation.isNotNull()
    return F.struct(
        registered.alias("registered"), left.alias("fraction"), F.when(paid, left * F.greatest(compensation, F.lit(0.0))).otherwise(0.0).alias("cash"), F.when(paid, 0.0).otherwise(left).alias("restricted")
    )


def terminal_payout(kind: Column, status: Column, price: Column, restricted: Column) -> Column:
    """struct(action, cash, restricted, review) of a security that ends, a share: only an official cash price is paid out; a swap waits for its ratio, everything else
    stays as a restricted asset."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit("unknown"))))
    paid = F.coalesce(k.isin("cash_liquidation", "cash_acquisition", "cash_option") & status.isin("official", "verified") & (price >= 0), F.lit(False))
    action = F.when(paid, "cash_settlement").when(k.isin("stock_swap", "merger"), "await_stock_conversion").otherwise("restrict_asset")
    return F.struct(action.alias("action"), F.when(paid, price).otherwise(0.0).alias("cash"), F.when(paid, 0.0).otherwise(F.greatest(restricted, F.lit(0.0))).alias("restricted"), (~paid).alias("review"))


def classify_news(title: Column, terms: dict[str, list[str]], events: list[tuple[str, list[str]]], calm: tuple[str, list[str]]) -> Column:
    """struct(event_type, direction, impact, impact_score, horizon_days) of a title, in small letters, by keywords.

    ``terms`` has positive and negative words, whose counts decide the direction, strong ones of both kinds (attack, relief), any of which counts as two
    more, and words of high risk. ``events`` are types with their words, of which the first that is met counts. ``calm`` names a type and words that make
    it neutral and of low impact.
    """
    t = F.lower(F.coalesce(title, F.lit("")))
    count = lambda words: sum((t.contains(w.lower()).cast("int") for w in words), F.lit(0))
    some = lambda words: count(words) > 0
    up = count(terms["positive"]) + 2 * some(terms["relief"]).cast("int")
    down = count(terms["negative"]) + 2 * some(terms["attack"]).cast("int")
    kind = first_keyword(t, [(k, [w.lower() for w in words]) for k, words in events], "other")
    quiet, risk = (kind == calm[0]) & some(calm[1]), some(terms["risk"])
    way = F.when(up > down, "positive").when(down > up, "negative").otherwise("neutral")
    level = lambda high, medium, low, calmed: F.when(quiet, calmed).when(risk, high).when(way != "neutral", medium).otherwise(low)
    days = F.when(risk, 30).when(way != "neutral", 14).otherwise(7)
    return F.struct(
        kind.alias("event_type"), F.when(quiet, "neutral").otherwise(way).alias("direction"), level("high", "medium", "low", "low").alias("impact"), level(80.0, 45.0, 20.0, 25.0).alias("impact_score"), days.alias("horizon_days")
    )


def advice(score: Column, news: Column, held: Column) -> tuple[Column, Column]:
    """Base and news score, clipped to 0..100, and one of five actions."""
    s = F.least(F.lit(100.0), F.greatest(F.lit(0.0), score + news))
    act = F.when(s >= 80, "add").when(s >= 60, "hold").when(s >= 40, "watch").when(held & (s < 20), "exit").otherwise("reduce")
    return s, act
