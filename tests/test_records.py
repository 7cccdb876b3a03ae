"""Factor panel, readiness, stability, vendor lines, CSV events, closing quotes, limits, statements, exposures and order events against plain versions of them."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators import evidence, factors, portfolio, relational
from tidemark.sources import feeds, lake
from tidemark.streaming import books, jobs

D = dt.date


def test_factor_panel_equals_a_plain_loop(spark):
    rng = random.Random(5)
    days = [D(2022, 1, 3) + dt.timedelta(days=i) for i in range(500)]
    bars = {c: [(d, 0.0 if rng.random() < 0.02 else 10 * math.exp(rng.gauss(0, 0.2))) for d in days[: 500 - 200 * c]] for c in (0, 1, 2)}
    figs = {0: [], 1: [], 2: []}
    for c in figs:
        for i in range(8):
            v = lambda: None if rng.random() < 0.3 else rng.uniform(-1, 1)
            figs[c].append((D(2022, 1 + i, 10), v(), v(), v(), v(), rng.choice([-5e6, 5e5, 2e6, None]), 1e6, 1e7))
        figs[c].append((D(2022, 9, 10), None, None, None, None, None, None, None))
    vals = {c: [(D(2022 + m // 12, 1 + m % 12, 5), rng.choice([0.1, 0.2, None]), rng.choice([0.3, None]), 7.0) for m in range(16)] for c in (0, 1)}
    vals[0] += [(D(2021, 1, 1) + dt.timedelta(days=9 * i), 0.01 * (i % 5), 0.3, 7.0) for i in range(20)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    b = df([(c, d, v) for c, x in bars.items() for d, v in x], "code long, trade_date date, close double")
    f = df([(c, r[0], *r) for c, x in figs.items() for r in x], "code long, period date, available_at date, roe double, gross_margin double, net_margin double, debt_ratio double, net_income double, cash double, assets double")
    v = df([(c, *r) for c, x in vals.items() for r in x], "code long, available_at date, ep double, bp double, market_cap double")
    firms = df([(0, False), (1, True)], "code long, finance boolean")
    got = {(r.code, r.trade_date): r.asDict() for r in factors.factor_panel(b, firms, f, v).collect()}
    seen = set()
    for c, x in bars.items():
        x = [(d, p) for d, p in x if p > 0]
        ends = [i for i in range(len(x)) if i + 1 == len(x) or x[i + 1][0].month != x[i][0].month]
        for i in ends:
            at, p = x[i][0], [q for _, q in x[: i + 1]]
            seen.add((c, at))
            n, ret = len(p), [b / a - 1 for a, b in zip(p, p[1:])]
            ma = lambda k: statistics.fmean(p[-k:])
            want = {"momentum_12_1": p[-22] / p[-253] - 1 if n > 252 else None, "momentum_6_1": p[-22] / p[-127] - 1 if n > 126 else None, "short_reversal": 1 - p[-1] / p[-22] if n > 21 else None}
            want["volatility_60"], want["volatility_120"] = (-statistics.stdev(ret[-k:]) if n > k else None for k in (60, 120))
            want["max_drawdown_120"] = min(b / max(p[-120:][: j + 1]) - 1 for j, b in enumerate(p[-120:])) if n >= 120 else None
            vote = lambda a, b: 1 if a >= b else -1
            want["trend"] = None if n < 20 else vote(p[-1], ma(20)) if n < 60 else (vote(p[-1], ma(20)) + vote(p[-1], ma(60)) + vote(ma(20), ma(60))) / 3
            known = [r for r in figs[c] if r[0] <= at and any(y is not None for y in r[1:])]
            last, bank = known[-1] if known else [None] * 8, c == 1
            roes = [r[1] for r in known[-8:] if r[1] is not None]
            before = [r[3] for r in known[-5:-1] if r[3] is not None]
            want |= {"roe": last[1], "financial_roe": last[1] if bank else None, "debt_ratio": None if bank else last[4], "gross_margin": None if bank else last[2]}
            want["earnings_stability"] = -statistics.stdev(roes) if len(roes) > 2 else None
            want["margin_change"] = last[3] - before[-1] if before and last[3] is not None and not bank else None
            want["ocf_to_profit"] = last[6] / last[5] if not bank and last[5] and last[5] >= 1e6 else None
            want["loss_profitability"] = None if last[5] is None else -1.0 if last[5] <= 0 else 0.0
            mean = lambda r: statistics.fmean(y for y in r[1:3] if y is not None) if r[1] is not None or r[2] is not None else None
            hist = sorted((r for r in vals.get(c, []) if r[0] <= at), key=lambda r: r[0])
            now = mean(hist[-1]) if hist else None
            all_ = [m for m in map(mean, hist) if m is not None]
            want["ep"] = hist[-1][1] if hist else None
            want["valuation_percentile"] = (sum(m < now for m in all_) + 0.5 * sum(m == now for m in all_)) / len(all_) if now is not None and len(all_) >= 24 else None
            for k, w in want.items():
                assert got[c, at][k] == (w if w is None else pytest.approx(w)), (c, at, k)
    assert seen == set(got) and any(r["valuation_percentile"] is not None for r in got.values())


def test_readiness_counts_known_names(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    at, late = D(2024, 2, 1), D(2024, 2, 2)
    members = df([(c, at) for c in range(1, 6)], "code long, at date")
    bars = df([(1, D(2024, 1, 30), 1.0), (2, D(2023, 1, 1), 1.0), (3, at, 0.0), (4, late, 1.0), (5, at, 2.0)], "code long, trade_date date, close double")
    firms = df([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "")], "code long, industry string")
    figures = df([(c, at, 0.1) for c in range(1, 6)] + [(1, late, None)], "code long, available_at date, roe double").withColumns({c: F.lit(None).cast("double") for c in ("gross_margin", "cash", "debt_ratio")})
    values = df([(c, D(2024, 1, 1), 0.1, None) for c in range(1, 6)], "code long, available_at date, ep double, bp double")
    r = factors.readiness(members, bars, firms, figures, values, 0.4).first()
    assert (r.members, r.prices, r.recent, r.industries, r.financials, r.valuations, r.fresh_valuations, r.complete, r.ratio, r.rejected) == (5, 3, 2, 4, 5, 5, 0, 2, 0.4, False)
    assert factors.readiness(members.limit(0), bars, firms, figures, values, 0.4).count() == 0


def test_stability_by_year_and_regime(spark):
    rng = random.Random(2)
    rows = [(c, D(2022, 11, 1) + dt.timedelta(days=i), rng.gauss(0.001, 0.01), rng.gauss(0.002 if i < 60 else -0.002, 0.03 if 40 < i < 80 else 0.004)) for c in (1, 2) for i in range(200)]
    x = spark.createDataFrame(rows, "code long, trade_date date, ret double, proxy double")
    got = {(r.code, r.year, r.regime): (r.days, r.log_active) for r in evidence.stability_slices(x).collect()}
    want = {}
    for c in (1, 2):
        own = [r for r in rows if r[0] == c]
        for i, (_, day, ret, b) in enumerate(own):
            past = [r[3] for r in own[max(0, i - 60) : i]]
            trend = math.prod(1 + p for p in past) - 1
            vol = statistics.stdev(past) * math.sqrt(252) if len(past) > 1 else 0
            label = "warmup" if len(past) < 20 else "high_volatility" if vol >= 0.3 else "bull" if trend >= 0.05 else "bear" if trend <= -0.05 else "sideways"
            for key in ((c, day.year, None), (c, None, label), (c, None, None)):
                n, s = want.get(key, (0, 0.0))
                want[key] = (n + 1, s + math.log(1 + ret - b))
    assert set(got) == set(want) and all(got[k] == (want[k][0], pytest.approx(want[k][1])) for k in want) and len({k[2] for k in want}) >= 4
    gate = {r.code: r for r in evidence.stability_gate(evidence.stability_slices(x)).collect()}
    years = {k: math.expm1(v[1]) for k, v in want.items() if k[1]}
    left = math.expm1(want[1, None, None][1] - max(v[1] for k, v in want.items() if k[0] == 1 and k[1]))
    assert gate[1].worst_year == pytest.approx(min(v for k, v in years.items() if k[0] == 1)) and gate[1].without_best == pytest.approx(left)


def test_quote_lines(spark):
    f = [str(i) for i in range(45)]
    f[1], f[2], f[3], f[30], f[37], f[38] = " Name ", "600000", "10.5", "20240131150000", "12.5", "250"
    line = lambda **k: 'v_sh="' + "~".join(k.get(f"f{i}", x) for i, x in enumerate(f)) + '";'
    short = 'v="' + "~".join(f[:38]) + '";'
    text = "\n".join([line(), line(f30="20240231150000"), short, "none", line(f30="soon"), line(f37=" ", f38="x", f2="000001"), '="'])
    got = feeds.quote_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), "text").collect()
    assert [(r.id, r.code, r.name, r.close, r.amount, r.turnover, r.observed_at) for r in got] == [
        (1, "600000", "Name", 10.5, 125000.0, 2.5, dt.datetime(2024, 1, 31, 15)), (1, "000001", "Name", 10.5, None, None, dt.datetime(2024, 1, 31, 15)),
    ]


def test_membership_csv(spark, tmp_path):
    head = "﻿index_code,stock_code,event_type,effective_date,available_at\n"
    (tmp_path / "a.csv").write_text(head + " 300 , 1 , ADD ,2020-01-01,\n300,1,add,2020-01-01,2020-01-01T09:00:00\n\n300,2,hold,2020-01-01,\n300,3,remove,20200103,soon\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text(head + ",4,add,2020-01-01,\n300,1234567,add,x,\n300,5,add\n300,6,add,2020-01-06,2020-01-05 08:00:00\n", encoding="utf-8")
    known = spark.createDataFrame([("300", "000006", D(2020, 1, 6), "remove"), ("300", "000003", D(2020, 1, 3), "remove")], "index_code string, stock_code string, effective_date date, event_type string")
    events, problems = lake.membership_csv(spark, str(tmp_path), known)
    assert sorted((r.stock_code, r.event_type, r.effective_date, r.available_at) for r in events.collect()) == [("000001", "add", D(2020, 1, 1), None), ("000006", "add", D(2020, 1, 6), dt.datetime(2020, 1, 5, 8))]
    assert sorted((r.file[-5:], r.line, r.reason) for r in problems.collect()) == [("a.csv", 5, "not valid"), ("a.csv", 6, "time not readable"), ("b.csv", 2, "not valid"), ("b.csv", 3, "not valid"), ("b.csv", 4, "not valid")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.csv").write_text("index_code,stock_code\n1,2\n")
    with pytest.raises(ValueError, match="effective_date, event_type"):
        lake.membership_csv(spark, str(tmp_path / "c"))


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 17)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        x = lake.numbered_lines(spark, str(tmp_path))
        assert x.count() == 3017 and x.where(F.substring("value", 2, 9) != F.col("line").cast("string")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_closing_quotes_and_limits(spark):
    day, other = D(2024, 1, 2), D(2024, 1, 3)
    rows = [(1, day, day, 10.0, 500.0, 5000.0), (2, day, day, 10.0, 5.0, 5000.0), (3, day, day, 10.0, 5.0, None), (4, day, other, 10.0, 5.0, 1.0), (5, day, day, 0.0, 5.0, 1.0), (6, day, None, 1.0, 1.0, 1.0), (9, day, day, 1.0, 1.0, 1.0)]
    snap = spark.createDataFrame(rows, "code long, trade_date date, quote_date date, close double, volume double, amount double")
    bars = spark.createDataFrame([(1, day, 9.0, 1.0, 1.0), (1, other, 9.0, 1.0, 1.0)], "code long, trade_date date, close double, volume double, amount double")
    got, bad = lake.market_close(snap, spark.range(1, 7).withColumnRenamed("id", "code"), "trade_date", bars)
    assert sorted((r.code, r.trade_date, r.volume, r.unit) for r in got.collect()) == [(1, day, 500.0, "share"), (1, other, 1.0, None), (2, day, 500.0, "lot"), (3, day, 500.0, "lot")]
    assert sorted((r.code, r.reason) for r in bad.collect()) == [(4, "other day"), (5, "no price"), (6, "other day")]
    limits = "code long, trade_date date, up_limit double, down_limit double"
    raw, derived = spark.createDataFrame([(1, day, 11.0, None)], limits), spark.createDataFrame([(1, day, 12.0, 8.0), (1, other, 13.0, 9.0)], limits)
    off = spark.createDataFrame([(1, other, "s"), (2, day, " S"), (1, day, "R"), (1, other, "S")], "code long, trade_date date, kind string")
    assert sorted((r.code, r.trade_date, r.up_limit, r.down_limit, r.origin, r.suspended) for r in lake.execution_limits(raw, derived, off).collect()) == [(1, day, 11.0, None, "raw", False), (1, other, 13.0, 9.0, "derived", True), (2, day, None, None, None, True)]


def test_statements_and_ledger_invariants(spark):
    rows = [(1, 100.0, 100.5, None, None, 10.0, 5.0, 15.0), (2, 100.0, None, 40.0, 50.0, 10.0, 5.0, 20.0), (3, 100.0, None, 40.0, None, None, 5.0, 20.0), (4, 0.0, 0.0, None, None, 0.0, 0.0, 0.01)]
    x = spark.createDataFrame(rows, "id long, assets double, liab_equity double, liabilities double, equity double, begin_cash double, cash_change double, end_cash double")
    got = {r.id: (r.errors, r.warnings, r.usable) for r in relational.statement_checks(x).collect()}
    assert got == {1: ([], [], True), 2: (["balance", "cash roll-forward"], [], False), 3: (["balance fields missing"], ["cash fields missing"], False), 4: ([], [], True)}
    orders = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 5.0)], "order_id long, quantity double")
    fills = spark.createDataFrame([(1, 6.0), (1, 5.0), (2, 10.0), (8, 1.0), (8, 1.0)], "order_id long, quantity double")
    days = spark.createDataFrame([(0.005,), (-0.5,), (None,)], "conservation_error double")
    count = lambda o, f, d: {r.kind: r.n for r in relational.ledger_invariants(o, f, d).collect()}
    assert count(orders, fills, days) == {"orphan_fills": 2, "overfilled_orders": 1, "conservation_breaks": 1}
    assert count(orders.limit(0), fills.limit(0), days.limit(0)) == {"orphan_fills": 0, "overfilled_orders": 0, "conservation_breaks": 0}


def test_exposures(spark):
    p = spark.createDataFrame([(1, "f", 60.0), (1, "g", 40.0), (2, "f", 0.0)], "account long, fund string, value double")
    h = spark.createDataFrame([("f", "x", 0.10), ("g", "x", 0.02), ("f", "y", 0.04), ("g", "y", 0.01), ("f", "z", 0.01), ("g", "z", 0.01), ("g", "v", 0.3)], "fund string, item string, weight double")
    i = spark.createDataFrame([("f", "banks", 0.5), ("g", "banks", 0.2), ("g", "mines", 0.5), ("f", "farms", 0.3)], "fund string, industry string, weight double")
    got = sorted((r.kind, r.subject, r.level, round(r.exposure, 6), r.funds) for r in portfolio.exposure_signals(p, h, i).collect())
    assert got == [("industry", "banks", "risk", 0.38, 2), ("industry", "mines", "warning", 0.2, 1), ("overlap", "x", "warning", 0.068, 2), ("overlap", "y", "warning", 0.028, 2), ("stock_exposure", "v", "risk", 0.12, 1), ("stock_exposure", "x", "warning", 0.068, 2)]
    falls = [("a", "cn", D(2024, 1, 1) + dt.timedelta(days=k), 100 - 0.6 * k) for k in range(21)] + [("b", "us", D(2024, 1, 1) + dt.timedelta(days=k), 100 + 0.6 * k) for k in range(21)] + [("c", "us", D(2024, 1, 1), 1.0)]
    q = spark.createDataFrame(falls, "code string, market string, trade_date date, close double")
    level = lambda w: {r.code: (r.level, r.exposure) for r in portfolio.index_signals(q, spark.createDataFrame([("cn", w)], "market string, weight double")).collect()}
    assert level(0.3) == {"a": ("risk", 0.3), "b": ("info", 0.0)} and level(0.2)["a"] == ("warning", 0.2)


def test_names_and_industries(spark):
    x = spark.createDataFrame([(1, "A(x)->B / *STB，C（y）->C"), (2, None), (3, " -> ")], "code long, text string")
    assert [(r.code, r.position, r.name, r.st) for r in portfolio.name_segments(x, "text").orderBy("code", "position").collect()] == [(1, 0, "A", False), (1, 1, "B", False), (1, 2, "*STB", True), (1, 3, "C", False)]
    rows = [("1.SZ", " n ", "L", "old", D(2019, 1, 1)), ("1.SZ", "", "", " new ", D(2021, 1, 1)), ("1.SZ", "n", "L", " ", D(2022, 1, 1)), ("2.SZ", "n", "L", None, D(2022, 1, 1))]
    y = spark.createDataFrame(rows, "ts_code string, name string, l1_code string, l1_name string, in_date date")
    assert [tuple(r) for r in portfolio.first_industry(y).collect()] == [("000001", None, None, "new")]


def test_tax_conversion_and_payout(spark):
    rows = [(D(2014, 1, 1), D(2014, 1, 31), D(2014, 1, 1)), (D(2014, 1, 1), D(2014, 2, 1), D(2014, 1, 1)), (D(2013, 1, 1), D(2015, 1, 1), D(2015, 9, 7)), (D(2013, 1, 1), D(2015, 1, 1), D(2015, 9, 8)), (D(2014, 1, 1), D(2013, 1, 1), D(2014, 1, 1)), (D(2014, 1, 1), D(2014, 1, 2), D(2012, 1, 1))]
    x = spark.createDataFrame(rows, "a date, s date, e date").select(rules.dividend_tax(F.col("a"), F.col("s"), F.col("e"), F.lit(100.0), F.lit(0.5), F.lit(1.0)).alias("t"))
    assert [r.t and (r.t.days, r.t.rate, r.t.rule[-4:], r.t.tax) for r in x.collect()] == [(30, 0.2, "2013", 9.0), (31, 0.1, "2013", 4.0), (730, 0.05, "2013", 1.5), (730, 0.0, "2015", 0.0), None, None]
    y = spark.createDataFrame([(10.25, 4.0), (10.25, None), (10.25, -1.0)], "raw double, c double").select(rules.convert_shares(F.col("raw"), F.col("c")).alias("s"))
    assert [tuple(r.s) for r in y.collect()] == [(10.0, 0.25, 1.0, 0.0), (10.0, 0.25, 0.0, 0.25), (10.0, 0.25, 0.0, 0.0)]
    z = spark.createDataFrame([(" Cash_Option", "verified", 2.0), ("cash_option", "draft", 2.0), ("merger", "official", 2.0), (None, None, None)], "k string, s string, p double")
    z = z.select(rules.terminal_payout(F.col("k"), F.col("s"), F.col("p"), F.lit(-1.0)).alias("e"))
    assert [tuple(r.e) for r in z.collect()] == [("cash_settlement", 2.0, 0.0, False), ("restrict_asset", 0.0, 0.0, True), ("await_stock_conversion", 0.0, 0.0, True), ("restrict_asset", 0.0, 0.0, True)]


def test_news_rules(spark):
    terms = {"positive": ["up"], "negative": ["down", "fine"], "attack": ["strike"], "relief": ["talks"], "risk": ["default"]}
    events = [("fund", ["dividend", "default"]), ("policy", ["rate"])]
    titles = {"Rate UP": ("policy", "positive", "medium", 45.0, 14), "down and strike, talks": ("other", "negative", "medium", 45.0, 14), "dividend default": ("fund", "neutral", "low", 25.0, 30), "default": ("fund", "neutral", "high", 80.0, 30), "": ("other", "neutral", "low", 20.0, 7), None: ("other", "neutral", "low", 20.0, 7)}
    x = spark.createDataFrame([(t,) for t in titles], "t string").withColumn("n", rules.classify_news(F.col("t"), terms, events, ("fund", ["dividend"])))
    assert {r.t: tuple(r.n) for r in x.collect()} == titles


def test_order_events_in_any_order(spark):
    books.keyed_state(spark)
    rng = random.Random(4)
    kinds = [*books.ORDER_STATUS, "note", None]
    rows = [(rng.randrange(40), i, rng.choice([None, rng.randrange(500)]), rng.choice(kinds[:1] * 9 + kinds), f"x{i}") for i in range(400)] + [(99, 900, 1, "note", "y")]
    want = {}
    for o in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == o), key=lambda r: (r[2] if r[2] is not None else 10**12 + r[1], r[1]))
        status = "created"
        for r in own:
            new = books.ORDER_STATUS.get(r[3])
            if new and not (status in books.TERMINAL and new not in books.TERMINAL):
                status = new
        want[o] = (status, len(own))
    schema = "order_id long, sequence long, broker_sequence long, event_type string, external_id string"
    mixed = rng.sample(rows, len(rows))
    x = spark.createDataFrame(mixed + mixed[:50], schema)
    assert {r.order_id: (r.status, r.events) for r in books.order_states(x, ["order_id"], ["external_id"]).collect()} == want
    folder, root = lake.scratch(spark, "in"), lake.scratch(spark, "out")
    parts = [spark.createDataFrame(p, schema) for p in (mixed[:150], mixed[100:300], mixed[250:] + mixed[:20])]
    run = lambda: jobs.run_to_table(books.order_stream(jobs.stream(spark, folder), ["order_id"], ["external_id"]), root, "append", ["order_id"])
    assert {r.order_id: (r.status, r.events) for r in jobs.in_turns(parts, folder, run).collect()} == want
