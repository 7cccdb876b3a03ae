import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, evidence, portfolio, relational, series, text_events
from tidemark.sources import lake
from tidemark.streaming import jobs

D = dt.date


def prices(spark, rows):
    return spark.createDataFrame([(c, D(2024, 1, 1) + dt.timedelta(days=i), v) for c, vs in rows.items() for i, v in enumerate(vs)], "code long, trade_date date, close double")


def test_trailing_year_from_year_to_date(spark):
    rows = [(1, y, i + 1, float(v)) for y, vs in ((2024, (20, 50, 80, 120)), (2025, (30, 70, 110, 160))) for i, v in enumerate(vs)]
    got = evidence.ttm(spark.createDataFrame(rows, "code long, year long, quarter long, v double"), "v").where("year = 2025").orderBy("quarter")
    assert [r.ttm for r in got.collect()] == [130.0, 140.0, 150.0, 160.0]


def test_ttm_with_a_missing_part_is_null(spark):
    rows = [(1, 2024, 1, 20.0), (1, 2025, 1, 30.0), (1, 2025, 2, 70.0)]
    assert [r.ttm for r in evidence.ttm(spark.createDataFrame(rows, "code long, year long, quarter long, v double"), "v").collect()] == [None] * 3


def test_three_quintile_rules_differ_at_twelve(spark):
    panel = spark.createDataFrame([(D(2024, 1, 1), i, float(i), float(i)) for i in range(12)], "month date, code long, score double, fwd double")
    a = {r.bucket: r.mean for r in series.quintile_a(panel).collect()}
    b = {r.bucket: r.mean for r in series.quintile_b(panel).collect()}
    assert a == {0: 1.0, 1: 3.5, 2: 6.0, 3: 8.5, 4: 10.5}  # 3, 2, 3, 2, 2
    assert b == {0: 0.5, 1: 2.5, 2: 5.0, 3: 7.5, 4: 10.0}  # 2, 2, 3, 2, 3


def test_quantile_rank_and_historical_percentile(spark):
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0, None])], "day string, code long, x double")
    assert [r.q for r in series.quantile_rank(df, ["day"], "x").orderBy("code").collect()] == [0.0, 0.375, 0.375, 0.75, None]
    hist = prices(spark, {1: [float(i) for i in range(30)] + [10.0]})
    assert series.historical_percentile(hist, "close").first().pct == (10 + 0.5) / 30


def test_wilder_index_and_moving_fold(spark):
    assert {r.rsi for r in series.rsi(prices(spark, {1: [float(i) for i in range(20)], 2: [5.0] * 20})).where("code = 1").collect()} == {100.0}
    assert {r.rsi for r in series.rsi(prices(spark, {2: [5.0] * 20})).collect()} == {50.0}
    e = series.ema(prices(spark, {1: [1.0, 2.0, 3.0]}), 3).orderBy("trade_date").collect()
    assert [r.ema3 for r in e] == [1.0, 1.5, 2.25]


def test_dividend_index(spark):
    x = prices(spark, {1: [1.00, 1.10, 1.00, 1.10]}).withColumn("acc", F.col("close") + F.when(F.col("trade_date") >= "2024-01-03", 0.2).otherwise(0.0))
    last = series.total_return_index(x, "close", "acc").orderBy(F.desc("trade_date")).first()
    assert last.idx == pytest.approx(1.10 * 1.2 / 1.10 * 1.1, abs=1e-9)


def test_asof_strict_kth_and_per_field(spark):
    rows = spark.createDataFrame([(1, D(2024, 1, 2), 1.0, None), (1, D(2024, 1, 5), None, 2.0), (1, D(2024, 1, 9), 3.0, None)], "code long, d date, a double, b double")
    probe = spark.createDataFrame([(1, D(2024, 1, 5)), (1, D(2024, 1, 1)), (2, D(2024, 1, 5))], "code long, at date")
    back = {(r.code, r.at.day): (r.d and r.d.day) for r in asof.asof_join(probe, rows, "code", "at", "d", ["a"]).collect()}
    strict = {(r.code, r.at.day): (r.d and r.d.day) for r in asof.asof_join(probe, rows, "code", "at", "d", ["a"], strict=True).collect()}
    field = {(r.code, r.at.day): (r.a, r.b) for r in asof.asof_join(probe, rows, "code", "at", "d", ["a", "b"], per_field=True).collect()}
    assert back == {(1, 5): 5, (1, 1): None, (2, 5): None}
    assert strict == {(1, 5): 2, (1, 1): None, (2, 5): None}
    assert field[(1, 5)] == (1.0, 2.0)
    kth = asof.kth_before(spark.createDataFrame([(1, D(2024, 1, 10))], "code long, at date"), rows, "code", "at", "d", 2).first()
    assert kth.d == D(2024, 1, 5)


def test_future_rows_change_nothing(spark):
    a = prices(spark, {1: [float(3 + (i * 7) % 11) for i in range(80)]})
    b = a.withColumn("close", F.when(F.col("trade_date") > "2024-02-29", 99.0).otherwise(F.col("close")))
    for f in (lambda x: series.volatility(series.daily_return(x), 20), lambda x: series.trend_strength(x), lambda x: series.exante_regime(series.daily_return(x)), lambda x: series.macd(x), lambda x: series.drawdown(x)):
        cut = lambda x, f=f: sorted(map(str, f(x).where("trade_date <= '2024-02-29'").collect()))
        assert cut(a) == cut(b)


def test_revisions_are_kept_and_retries_replaced(spark):
    cols = "code string, effective_date date, value double, available_at date"
    stored = spark.createDataFrame([("F", D(2024, 1, 2), 1.0, D(2024, 1, 2))], cols).withColumn("row_hash", lake.row_hash(["value"]))
    retry = stored
    revised = stored.withColumn("value", F.lit(1.05)).withColumn("available_at", F.lit(D(2024, 1, 5))).withColumn("row_hash", lake.row_hash(["value"]))
    assert lake.versioned_append(stored, retry, ["code", "effective_date"]).count() == 1
    both = lake.versioned_append(stored, revised, ["code", "effective_date"])
    assert both.count() == 2
    at = lambda day: [r.value for r in series.latest_version(both.where(F.col("available_at") <= day), ["code", "effective_date"], ["available_at", "row_hash"]).collect()]
    assert at("2024-01-03") == [1.0] and at("2024-01-06") == [1.05]


def test_year_partitions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, D(2023, 5, 1)), (2, D(2024, 5, 1))], "k long, effective_date date")
    lake.write_years(df, str(tmp_path / "t"))
    lake.write_years(df.where("k = 2").withColumn("k", F.lit(9).cast("long")), str(tmp_path / "t"))
    assert sorted(r.k for r in lake.read_years(spark, str(tmp_path / "t")).collect()) == [1, 9]


def test_membership_events_from_snapshots(spark):
    s = spark.createDataFrame([("i", c, D(2024, m, 1)) for m, cs in ((1, "ab"), (2, "bc"), (3, "c")) for c in cs], "idx string, code string, day date")
    got = sorted((r.effective_date.month, r.code, r.event_type) for r in relational.set_difference_events(s, "idx", "code", "day").collect())
    assert got == [(2, "a", "remove"), (2, "c", "add"), (3, "b", "remove")]


def test_tier_quota_fills_spare_places(spark):
    t = spark.createDataFrame([(i, "A" if i < 2 else "B") for i in range(20)], "code long, tier string")
    got = relational.tier_quota(t, [("A", 0.7), ("B", 0.25), ("C", 0.05)], 10)
    assert got.count() == 10 and got.where("tier = 'A'").count() == 2


def test_weight_caps_add_up(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), i, s) for i, s in enumerate([10.0, 1.0, 1.0, 1.0, 1.0, 1.0])], "month date, code long, score double")
    w = [r.weight for r in relational.capped_weights(df, "month", 0.3).collect()]
    assert sum(w) == pytest.approx(1) and max(w) <= 0.3 + 1e-9


def test_neutralised_values_do_not_follow_the_exposures(spark):
    rows = [(D(2024, 1, 1), i, f"g{i % 2}", 2.0 * i + (5 if i % 2 else 0) + ((i * 37) % 11) / 1e3, float(i), float(1 + i)) for i in range(100)]
    df = spark.createDataFrame(rows, "month date, code long, industry string, v double, size double, cap double")
    res = evidence.neutralize_wls(df, "v", "industry", ["size"], "cap")
    assert abs(res.agg(F.sum("residual")).first()[0]) < 1 and res.agg(F.max(F.abs("residual"))).first()[0] < 0.02


LEDGER = "account long, event_id string, day date, type string, quantity double, price double, fee double"


def test_ledger_applies_an_event_once(spark):
    rows = [(1, "a", D(2024, 1, 1), "buy", 10.0, 5.0, 1.0), (1, "a", D(2024, 1, 1), "buy", 10.0, 5.0, 1.0), (1, "b", D(2024, 1, 2), "sell", 4.0, 6.0, 1.0)]
    got = jobs.replay_ledger(spark.createDataFrame(rows, LEDGER), ["account"], ["day", "event_id"], 100.0).first()
    assert (got.cash, got.held, got.fees, got.events) == (72.0, 6.0, 2.0, 2)


def ledger_rows(seed):
    rng = random.Random(seed)
    kinds = ["buy", "buy", "sell", "sell", "dividend", "tax", "split", "rights", "swap_in", "swap_out", "note"]
    out = []
    for i in range(400):
        k = rng.choice(kinds)
        q = {"split": rng.choice([2.0, 0.5]), "rights": 0.1}.get(k, float(rng.randrange(1, 40)))
        out.append((i % 3, f"e{i:04d}", D(2024, 1, 1) + dt.timedelta(days=i // 2), k, q, 1.0 + i % 7, 0.5))
    return out + out[:50]


def test_ledger_equals_a_plain_fold(spark):
    """Also over months, with splits, rights, swaps and sales of more than is held."""
    rows = ledger_rows(3)
    want = {}
    for account in range(3):
        cash, held, fees = 1000.0, 0.0, 0.0
        for _, _, _, k, q, p, f in sorted({r for r in rows if r[0] == account}, key=lambda r: (r[2], r[1])):
            if k == "buy":
                cash, held, fees = cash - q * p - f, held + q, fees + f
            elif k == "sell":
                cash, held, fees = cash + min(held, q) * p - f, held - min(held, q), fees + f
            elif k in ("dividend", "tax"):
                cash += held * p * (1 if k == "dividend" else -1)
            elif k == "split":
                held *= q
            elif k == "rights":
                cash, held = cash - held * q * p, held * (1 + q)
            elif k == "swap_in":
                held += q
            elif k == "swap_out":
                held -= min(held, q)
        want[account] = (cash, held, fees)
    for r in jobs.replay_ledger(spark.createDataFrame(rows, LEDGER), ["account"], ["day", "event_id"], 1000.0).collect():
        assert (r.cash, r.held, r.fees) == pytest.approx(want[r.account])


def test_lots_equal_a_plain_fold(spark):
    rows = [r for r in ledger_rows(5) if r[3] in ("buy", "sell")]
    want = []
    for account in range(3):
        lots = []
        for _, _, day, k, q, _, _ in sorted({r for r in rows if r[0] == account}, key=lambda r: (r[2], r[1])):
            if k == "buy":
                lots.append([day, q])
            while k == "sell" and q > 0 and lots:
                take = min(q, lots[0][1])
                lots[0][1], q = lots[0][1] - take, q - take
                if not lots[0][1]:
                    lots.pop(0)
        want += [(account, d, round(q, 6), d + dt.timedelta(days=1)) for d, q in lots]
    got = jobs.fifo_lots(spark.createDataFrame(rows, LEDGER), ["account"], ["day", "event_id"]).collect()
    assert sorted((r.account, r.acquired, round(r.quantity, 6), r.sellable) for r in got) == sorted(want)


def test_nested_intervals_give_the_latest_start_that_holds_the_day(spark):
    rng = random.Random(4)
    iv = [(k, D(2024, 1, 1) + dt.timedelta(days=a), None if rng.random() < 0.1 else D(2024, 1, 1) + dt.timedelta(days=a + rng.randrange(0, 90))) for k in range(3) for a in rng.sample(range(200), 25)]
    iv += [(7, D(2024, 1, 1), None), (7, D(2024, 3, 1), D(2024, 4, 30)), (8, D(2024, 5, 1), D(2024, 4, 1)), (8, None, None)]
    probes = [(k, D(2024, 1, 1) + dt.timedelta(days=i)) for k in (0, 1, 2, 7, 8, 9) for i in range(-3, 300, 7)]
    got = asof.interval_join(spark.createDataFrame(probes, "code long, at date"), spark.createDataFrame(iv, "code long, start date, end date"), "code", "at", "start", "end")
    want = set()
    for k, at in probes:
        best = max(((s, e) for c, s, e in iv if c == k and s and s <= at and (e is None or at <= e)), key=lambda x: x[0], default=(None, None))
        want.add((k, at, *best))
    assert {tuple(r) for r in got.collect()} == want


def test_normal_distribution(spark):
    z = [-7.5, -4.1, -2.5, -1.0, -0.3, 0.0, 0.1, 0.66, 1.96, 3.3, 5.9]
    df = spark.createDataFrame([(v,) for v in z], "z double").withColumn("p", evidence.normal_cdf(F.col("z"))).withColumn("back", evidence.normal_ppf(F.col("p")))
    for r in df.collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), rel=1e-12, abs=1e-15)
        assert r.back == pytest.approx(r.z, abs=1e-8) or r.z > 5
    q = {0.975: 1.959963984540054, 0.5: 0.0, 0.01: -2.3263478740408408, 1e-6: -4.753424308822899}
    got = spark.createDataFrame([(v,) for v in q], "p double").select("p", evidence.normal_ppf(F.col("p")).alias("z")).collect()
    assert all(r.z == pytest.approx(q[r.p], rel=1.2e-9, abs=1e-12) for r in got)


def test_overfitting_by_hand(spark):
    perf = spark.createDataFrame([(t, p, v) for t, vs in {"a": (3.0, 1.0), "b": (1.0, 2.0), "c": (2.0, 3.0)}.items() for p, v in enumerate(vs)], "trial string, period int, performance double")
    splits = spark.createDataFrame([(0, 0, True), (0, 1, False), (1, 0, False), (1, 1, True)], "split int, period int, inside boolean")
    got = {r.split: r for r in evidence.pbo(perf, splits).collect()}
    assert (got[0].trial, got[0].rel_rank, got[0].overfit, got[0].degradation) == ("a", pytest.approx(1 / 3), True, -2.0)
    assert (got[1].trial, got[1].rel_rank, got[1].overfit, got[1].degradation) == ("c", pytest.approx(2 / 3), False, -1.0)
    s = evidence.pbo_summary(evidence.pbo(perf, splits)).first()
    assert (s.splits, s.pbo, s.mean_degradation, s.median_logit) == (2, 0.5, -1.5, pytest.approx(math.log(2)))


def test_a_chain_break_is_found_where_it_is(spark):
    df = spark.createDataFrame([(1, i, f"p{i}") for i in range(8)] + [(2, i, None if i == 3 else "x") for i in range(5)], "day long, event_id long, props string")
    c = jobs.chain(df, "day", "event_id", "props")
    assert jobs.first_break(c, "day", "event_id", "props").count() == 0
    changed = c.withColumn("props", F.when(F.col("event_id") == 4, "other").otherwise(F.col("props")))
    assert {(r.day, r.first_break) for r in jobs.first_break(changed, "day", "event_id", "props").collect()} == {(1, 4), (2, 4)}
    again = changed.withColumn("entry_hash", F.when(F.col("event_id") == 4, jobs.entry_hash("props")).otherwise(F.col("entry_hash")))
    assert {(r.day, r.first_break) for r in jobs.first_break(again, "day", "event_id", "props").collect()} == {(1, 5)}


def test_conservation_finds_the_missing_cash(spark):
    deltas = spark.createDataFrame([("a", D(2024, 1, i), float(i)) for i in range(1, 6)], "k string, day date, delta double")
    good = spark.createDataFrame([("a", D(2024, 1, 1), 11.0), ("a", D(2024, 1, 5), 25.0), ("b", D(2024, 1, 1), 5.0)], "k string, day date, balance double")
    got = {r.k: r for r in jobs.conservation(deltas, good, ["k"], "day").collect()}
    assert (got["a"].total, got["a"].ok, got["b"].ok) == (14.0, True, True)
    bad = jobs.conservation(deltas, good.withColumn("balance", F.when(F.col("day") == "2024-01-05", 20.0).otherwise(F.col("balance"))), ["k"], "day").where("k = 'a'").first()
    assert (bad.error, bad.ok) == (-5.0, False)


def similar_brute(rows):
    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    out = set()
    for a, x, s in rows:
        for b, y, t in rows:
            if a < b and x and y and abs((s - t).days) <= 2:
                short, long = sorted((x, y), key=len)
                if x == y or len(short) >= 14 and short in long or len(short) >= 12 and 1 - edits(x, y) / len(long) >= 0.76:
                    out.add((a, b))
    return out


def test_no_similar_title_is_lost(spark):
    rng = random.Random(6)
    words = ["market", "markets", "falls", "bank", "rate", "cut", "a", "by", "surprise", "gains", "oil"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(12)]
    rows = []
    for i in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = rng.choice("abc ")
        t = "".join(t) if rng.random() < 0.8 else " ".join(["".join(t), rng.choice(base)])
        rows.append((i, " ".join(t.split()), D(2024, 1, 1 + rng.randrange(8))))
    items = spark.createDataFrame([(i, t, dt.datetime(d.year, d.month, d.day, i % 24)) for i, t, d in rows] + [(900, None, dt.datetime(2024, 1, 1)), (901, "", dt.datetime(2024, 1, 1))], "news_id long, title string, published_at timestamp")
    pairs = {(r.a, r.b) for r in text_events.similar_pairs(items).collect()}
    want = similar_brute(rows)

    def closed(edges):
        root = {i: i for i, _, _ in rows}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
        return {i: find(i) for i in root}

    assert pairs <= want and closed(pairs) == closed(want)
    events = text_events.cluster_events(items.withColumns({"summary": F.col("title"), "quality": F.lit(0.5)}), text_events.similar_pairs(items)).collect()
    assert {r.event for r in events} == set(closed(want).values()) | {900, 901}


def test_held_sum_equals_the_two_sided_cusum(spark):
    rng = random.Random(9)
    v = [rng.gauss(0, 1) for _ in range(60)] + [3.0] * 5
    got = series.cusum(prices(spark, {1: v}), "close").first()
    med = sorted(v)[len(v) // 2]
    mad = sorted(abs(x - med) for x in v)[len(v) // 2] * 1.4826
    up = down = peak = 0.0
    for x in v:
        z = (x - med) / mad
        up, down = max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)
        peak = max(peak, up, down)
    assert got.peak == pytest.approx(peak)


def cross_section(seed, n):
    rng = random.Random(seed)
    out = []
    for m in (1, 2):
        for i in range(n):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            out.append((D(2024, m, 1), i, a, b, a + 0.3 * rng.gauss(0, 1), 1.0 + 2.0 * a - b + rng.gauss(0, 0.1), 1.0 + i))
    return out + [(D(2024, 1, 1), 999, None, 1.0, 1.0, 1.0, 1.0)]


SECTION = "month date, code long, a double, b double, c double, y double, cap double"


def test_factor_returns_equal_least_squares(spark):
    import numpy as np

    rows = cross_section(1, 40)
    got = {(r.month, r.factor): r for r in evidence.factor_returns(spark.createDataFrame(rows, SECTION), "month", "y", ["a", "b"], "cap").collect()}
    for m in (1, 2):
        x = np.array([(1.0, r[2], r[3], r[5], r[6]) for r in rows if r[0] == D(2024, m, 1) and r[2] is not None])
        s = np.sqrt(np.sqrt(x[:, 4]))[:, None]
        beta = np.linalg.lstsq(x[:, :3] * s, x[:, 3] * s[:, 0], rcond=None)[0]
        for f, v in zip(("intercept", "a", "b"), beta, strict=True):
            assert got[D(2024, m, 1), f].factor_return == pytest.approx(v)
        assert got[D(2024, m, 1), "a"].specific_var == pytest.approx(np.var(x[:, 3] - x[:, :3] @ beta))


def test_manifest_reads_changed_files_only_and_finds_what_differs(spark, tmp_path):
    root = str(tmp_path / "files")
    spark.range(10).repartition(2).write.parquet(root)
    first = lake.written(lake.file_manifest(spark, root), "manifest")
    assert sorted(r.n_rows for r in first.collect()) == [5, 5] and first.where("length(sha256) = 64 and bytes > 0").count() == 2
    # An entry whose size and time still hold is kept as it is, without a look at the file.
    marked = lake.written(first.withColumn("sha256", F.lit("kept")), "manifest")
    spark.range(3).coalesce(1).write.mode("append").parquet(root)
    again = lake.file_manifest(spark, root, known=marked)
    assert sorted((r.n_rows, r.sha256 == "kept") for r in again.collect()) == [(3, False), (5, True), (5, True)]
    checked = lake.verify_manifest(first.withColumn("sha256", F.when(F.col("file") == first.first().file, "other").otherwise(F.col("sha256"))), lake.file_manifest(spark, root))
    assert sorted(r.status for r in checked.collect()) == ["hash_mismatch", "verified"]


def test_risk_of_a_book(spark):
    cov = spark.createDataFrame([("a", "a", 0.04), ("a", "b", 0.01), ("b", "b", 0.09)], "a string, b string, cov double")
    w = spark.createDataFrame([("a", 0.6, 0.5), ("b", 0.4, 0.5)], "name string, weight double, benchmark double")
    got = {r.name: r for r in evidence.portfolio_risk(cov, w, "name").collect()}
    assert got["a"].variance == pytest.approx(0.36 * 0.04 + 2 * 0.24 * 0.01 + 0.16 * 0.09)
    assert got["a"].contribution + got["b"].contribution == pytest.approx(1)
    assert got["b"].tracking_error == pytest.approx((0.01 * 0.04 - 2 * 0.01 * 0.01 + 0.01 * 0.09) ** 0.5)
    days = evidence.liquidation_days(spark.createDataFrame([(1000.0, 100.0, True), (1000.0, 100.0, False)], "v double, adv double, ok boolean"), "v", "adv", "ok").collect()
    assert [(r.normal_days, r.stress_days) for r in days] == [(100.0, pytest.approx(1000 / 3)), (100.0, None)]


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    rows = lambda a, b: spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), "x", 1.0) for i in range(a, b)], "event_id long, ts timestamp, event_type string, value double")
    rows(0, 50).write.parquet(str(tmp_path / "e"))
    run = lambda: jobs.run_to_table(jobs.tumbling(jobs.stream(spark, str(tmp_path / "e")), "ts", "event_type", "value", "1 hour"), str(tmp_path / "w"), "update", ["start", "event_type"])
    assert run().agg(F.sum("n")).first()[0] == 50
    rows(50, 80).write.mode("append").parquet(str(tmp_path / "e"))
    assert run().agg(F.sum("n")).first()[0] == 80 and run().agg(F.sum("n")).first()[0] == 80


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), "x" if i % 3 else "y", float(i)) for i in range(200)], "event_id long, ts timestamp, event_type string, value double")
    df.repartition(3).write.parquet(str(tmp_path / "e"))
    got = jobs.run_to_table(jobs.tumbling(jobs.stream(spark, str(tmp_path / "e")), "ts", "event_type", "value", "1 hour"), str(tmp_path / "w"))
    want = df.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_fdr_and_bootstrap_order_statistics(spark):
    p = spark.createDataFrame([(i, v) for i, v in enumerate([0.01, 0.04, 0.03, 0.5])], "code long, p double")
    assert [round(r.q, 6) for r in evidence.fdr_bh(p, "p", "code").orderBy("code").collect()] == [0.04, 0.053333, 0.053333, 0.5]
    m = spark.createDataFrame([(i, float(i)) for i in range(100)], "replicate long, mean double")
    assert tuple(evidence.bootstrap_ci(m, 100).first()) == (2.0, 96.0)
