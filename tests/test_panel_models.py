"""Panel regressions from sums against the same regressions on the rows."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.operators import models

D = dt.date


def panel(seed, months, names):
    rng = random.Random(seed)
    rows = []
    for m in range(months):
        for i in range(names):
            a, b = rng.gauss(0, 1), rng.gauss(3, 2)
            c = a + 0.3 * rng.gauss(0, 1)
            rows.append([D(2020 + m // 12, 1 + m % 12, 1), i, f"g{i % 3}", None if rng.random() < 0.05 else a, b, c, 0.5 * a - 0.2 * b + (i % 3) + rng.gauss(0, 0.5)])
    return rows


SCHEMA = "month date, code long, industry string, a double, b double, c double, y double"


def plain_net(x, y, alpha, ratio):
    if ratio <= 0:
        p = np.eye(x.shape[1]) * alpha
        p[0, 0] = 0
        return np.linalg.pinv(x.T @ x + p) @ (x.T @ y)
    w = np.zeros(x.shape[1])
    for _ in range(2000):
        old = w.copy()
        for j in range(len(w)):
            raw = x[:, j] @ (y - x @ w + x[:, j] * w[j])
            w[j] = raw / (x[:, j] @ x[:, j]) if j == 0 else math.copysign(max(abs(raw) - alpha * ratio, 0), raw) / (x[:, j] @ x[:, j] + alpha * (1 - ratio))
        if np.abs(w - old).max() < 1e-10:
            break
    return w


def test_walk_forward_equals_plain_coordinate_descent(spark):
    rows = panel(1, 20, 12)
    alphas, ratios = (0.1, 5.0, 60.0), (0.0, 0.5, 1.0)
    got = models.walk_forward(spark.createDataFrame(rows, SCHEMA), ["a", "b", "c"], "y", "month", "industry", least=12, alphas=alphas, ratios=ratios).collect()
    months = sorted({r[0] for r in rows})
    assert {r.month for r in got} == set(months[12:])
    target = {}
    for m in months:
        for g in ("g0", "g1", "g2"):
            own = [r for r in rows if r[0] == m and r[2] == g]
            target.update({(m, r[1]): r[6] - np.mean([o[6] for o in own]) for r in own})
    value = {(r.month, r.code): r for r in got}
    raw = lambda ms: np.array([[v or 0.0 for v in r[3:6]] for r in rows if r[0] in ms])
    ys = lambda ms: np.array([target[r[0], r[1]] for r in rows if r[0] in ms])
    for i in (12, 15, 19):
        tail = max(3, i // 5)
        inner, last, whole = months[: i - tail], months[i - tail : i], months[:i]

        def fit(ms, alpha, ratio):
            x = raw(ms)
            mean, scale = x.mean(axis=0), x.std(axis=0)
            design = lambda z: np.column_stack([np.ones(len(z)), (z - mean) / scale])
            w = plain_net(design(x), ys(ms), alpha, ratio)
            return lambda z: design(z) @ w

        _, alpha, ratio = min((float(np.mean((ys(last) - fit(inner, a, r)(raw(last))) ** 2)), a, r) for a in alphas for r in ratios)
        want = fit(whole, alpha, ratio)(raw([months[i]]))
        own = [r for r in rows if r[0] == months[i]]
        for r, w in zip(own, want, strict=True):
            v = value[r[0], r[1]]
            assert (v.alpha, v.l1_ratio) == (alpha, ratio) and v.prediction == pytest.approx(w, abs=1e-7) and v.actual == pytest.approx(target[r[0], r[1]], abs=1e-9)


def test_later_months_change_no_prediction(spark):
    rows = panel(2, 18, 8)
    run = lambda rs: {(r.month, r.code): r.prediction for r in models.walk_forward(spark.createDataFrame(rs, SCHEMA), ["a", "b"], "y", "month", "industry").collect()}
    before = run(rows)
    after = run([r if r[0] < D(2021, 4, 1) else [*r[:6], -9.0 * r[6]] for r in rows])
    assert all(before[k] == pytest.approx(after[k]) for k in before if k[0] <= D(2021, 4, 1)) and any(before[k] != pytest.approx(after[k]) for k in before)


def ranks(v):
    return np.array([np.sum(v < x) + (np.sum(v == x) + 1) / 2 for x in v])


def test_redundancy_equals_regressions_of_each_month(spark):
    rows = panel(3, 3, 25)
    for r in rows:
        if r[0] == D(2020, 2, 1):
            r[5] = None if r[1] > 5 else r[5]  # too few values: no factor of this month
        if r[0] == D(2020, 3, 1) and r[1] > 6:
            r[6] = None  # too few returns: no regression in this month
    got = {(r.month, r.factor): r for r in models.redundancy(spark.createDataFrame(rows, SCHEMA), ["a", "b", "c"], "y").collect()}
    for m, cols in ((D(2020, 1, 1), [3, 4, 5]), (D(2020, 2, 1), [3, 4])):
        whole = np.array([[*(r[c] for c in cols), r[6]] for r in rows if r[0] == m and all(r[c] is not None for c in cols)], dtype=float)
        for i, c in enumerate(cols):
            rest = np.column_stack([np.ones(len(whole)), np.delete(whole[:, :-1], i, axis=1)])
            e = whole[:, i] - rest @ np.linalg.lstsq(rest, whole[:, i], rcond=None)[0]
            g = got[m, "abc"[c - 3]]
            assert g.vif == pytest.approx(np.var(whole[:, i]) / np.var(e))
            assert g.conditional_ic == pytest.approx(np.corrcoef(ranks(e), ranks(whole[:, -1]))[0, 1])
            own = np.array([(r[c], r[6]) for r in rows if r[0] == m and r[c] is not None])
            assert g.marginal_ic == pytest.approx(np.corrcoef(ranks(own[:, 0]), ranks(own[:, 1]))[0, 1])
            both = [np.corrcoef(*np.array([(r[c], r[o]) for r in rows if r[0] == m and r[c] is not None and r[o] is not None]).T)[0, 1] for o in (3, 4, 5) if o != c]
            assert g.mean_corr == pytest.approx(np.mean(both))
    assert got[D(2020, 2, 1), "c"].vif is None and got[D(2020, 3, 1), "a"].vif is None and got[D(2020, 3, 1), "a"].marginal_ic is not None


def test_alpha_evidence_equals_a_plain_sandwich_and_bootstrap(spark):
    rng = random.Random(5)
    rows = []
    for s in range(2):
        last = 0.0
        for i in range(90):
            m, v = rng.gauss(0, 1), rng.gauss(0, 1)
            last = 0.4 * last + rng.gauss(0, 0.3)
            rows.append((s, D(2024, 1, 1) + dt.timedelta(days=i), 0.2 + 0.8 * m + 0.3 * v + last if i != 7 else None, m, v))
    rows += [(9, D(2024, 1, 1), 1.0, 1.0, 1.0)]
    samples = 60
    df = spark.createDataFrame(rows, "s long, day date, ret double, mkt double, style double")
    got = {r.s: r for r in models.alpha_evidence(df, "s", "day", "ret", "mkt", ["style"], samples=samples).collect()}
    assert set(got) == {0, 1}
    for s, g in got.items():
        d = np.array([r[2:] for r in rows if r[0] == s and r[2] is not None])
        n, x, y = len(d), np.column_stack([np.ones(len(d)), d[:, 1:]]), d[:, 0]
        lag = max(1, int(n**0.25))

        def spread(u):
            out = u.T @ u
            for k in range(1, lag + 1):
                out += (1 - k / (lag + 1)) * (u[k:].T @ u[:-k] + u[:-k].T @ u[k:])
            return out

        b = np.linalg.lstsq(x, y, rcond=None)[0]
        inverse = np.linalg.inv(x.T @ x)
        se = math.sqrt((inverse @ spread(x * (y - x @ b)[:, None]) @ inverse)[0, 0])
        active = y - d[:, 1]
        assert (g.n, g.alpha, g.alpha_se, g.alpha_t) == pytest.approx((n, b[0], se, b[0] / se)) and g.betas == pytest.approx(b[1:])
        assert g.active_t == pytest.approx(active.mean() / (math.sqrt(spread((active - active.mean())[:, None])[0, 0]) / n))
        block, alphas, means = int(math.sqrt(n)), [], []
        for i in range(samples):
            index = []
            for j in range(-(-n // block)):
                start = int(hashlib.md5(f"s|{i}|{j}".encode()).hexdigest()[:8], 16) % n
                index += [(start + o) % n for o in range(block)]
            index = index[:n]
            alphas.append(np.linalg.lstsq(x[index], y[index], rcond=None)[0][0])
            means.append(active[index].mean())
        at = lambda v, p: sorted(v)[int(p * (samples - 1))]
        assert (g.alpha_low, g.alpha_high, g.active_low, g.active_high) == pytest.approx((at(alphas, 0.025), at(alphas, 0.975), at(means, 0.025), at(means, 0.975)))


def test_perturbed_weights(spark):
    grid = models.weight_grid({"a": 0.5, "b": 0.02}, 0.05)
    assert len(grid) == 5 and all(sum(g.values()) == pytest.approx(1) for g in grid) and grid[3]["b"] == 0
    rows = panel(6, 6, 20)
    weights = {"a": 0.6, "b": 0.4}
    got = models.perturbed(spark.createDataFrame(rows, SCHEMA), weights, "y").first()
    values = []
    for g in models.weight_grid(weights):
        per = [np.corrcoef(*np.array([((r[3] or 0) * g["a"] + r[4] * g["b"], r[6]) for r in rows if r[0] == m]).T)[0, 1] for m in sorted({r[0] for r in rows})]
        values.append(np.mean(per))
    assert got.center == pytest.approx(values[0]) and got.share == pytest.approx((sum(v < values[0] for v in values)) / 5)
    assert (got.low, got.high) == pytest.approx((sorted(values)[1], sorted(values)[-2]))


def test_neutralisation_equals_the_dummy_regression(spark):
    import pandas as pd

    from tidemark.operators.evidence import neutralize_wls

    rng = random.Random(7)
    rows = []
    for m in (1, 2, 3):
        for i in range(80 if m < 3 else 20):
            rows.append((i, D(2024, m, 1), None if i % 19 == 0 else rng.gauss(0, 1) + i % 4, "abcd"[i % 4] if i % 40 else ("rare" if i == 0 else None), None if i % 11 == 3 else rng.gauss(5, 2), rng.gauss(0, 1), float(rng.randrange(1, 5000))))
    got = {(r.code, r.month): r.residual for r in neutralize_wls(spark.createDataFrame(rows, "code long, month date, v double, ind string, size double, beta double, cap double"), "v", "ind", ["size", "beta"], "cap").collect()}
    for m in (1, 2):
        p = pd.DataFrame([r for r in rows if r[1] == D(2024, m, 1) and r[2] is not None], columns=["code", "month", "v", "ind", "size", "beta", "cap"])
        n = p.groupby("ind")["ind"].transform("size")
        x = [pd.get_dummies(p["ind"].where(n >= 3, "other").fillna("other")).to_numpy(float)]
        for c in ("size", "beta"):
            x.append(np.column_stack([p[c].fillna(p[c].median()), p[c].isna()]).astype(float))
        x, w = np.column_stack(x), np.sqrt(p["cap"])
        w = np.sqrt(w.clip(*w.quantile([0.01, 0.99])).to_numpy())
        e = p["v"].to_numpy() - x @ (np.linalg.pinv(x * w[:, None]) @ (p["v"].to_numpy() * w))
        assert [got[c, D(2024, m, 1)] for c in p["code"]] == pytest.approx(e.tolist(), abs=1e-8)
        assert sum(k[1] == D(2024, m, 1) for k in got) == len(p)
    assert {v for k, v in got.items() if k[1] == D(2024, 3, 1)} == {None}


def test_screening_tiers(spark):
    from tidemark.operators.evidence import screen

    rows = [("m1", f"a{i}", "x", float(i), None, 1.0 if i else -1.0, 0.0, "neutral") for i in range(10)]
    rows += [("m1", f"b{i}", "y", 20.0 + i, None, 1.0, 0.0, "risk_off") for i in range(3)]  # few: judged in the whole month
    rows += [("m2", f"c{i}", "y", float(i), 0.1, None, 0.0, "risk_off") for i in range(4)]  # too few in the month as well
    got = {r.code: r for r in screen(spark.createDataFrame(rows, "month string, code string, market string, mom double, ram double, trend double, dd double, regime string")).collect()}
    assert [got[f"a{i}"].tier for i in range(10)] == [-2, -1, -1, 0, 0, 0, 0, 1, 1, 2]
    assert [got[f"b{i}"].tier for i in range(3)] == [0, 0, 1] and {got[f"c{i}"].tier for i in range(4)} == {0}


def test_factor_health_against_history(spark):
    from tidemark.operators.relational import against_history, bucket_means

    rows = [("f", 1, 2.0, ""), ("f", 2, -1.0, "coverage"), ("f", 3, -500.0, ""), ("f", 4, None, ""), ("g", 1, 1.0, ""), ("g", 2, -1.0, "")]
    got = {(r.factor, r.month): (r.reasons, r.blocked) for r in against_history(spark.createDataFrame(rows, "factor string, month int, median double, reasons string"), "factor", "month", ["f"]).collect()}
    assert got == {("f", 1): ("", False), ("f", 2): ("coverage,sign", True), ("f", 3): ("scale", True), ("f", 4): ("", False), ("g", 1): ("", False), ("g", 2): ("", False)}
    df = spark.createDataFrame([("s", 0.5, 1.0), ("s", 1.0, 3.0), ("s", 9.0, 5.0), ("s", 9.5, 7.0)], "side string, x double, y double")
    assert {(r.x_bucket, r.n, r.mean) for r in bucket_means(df, ["side"], {"x": ([1.0, 5.0], ["low", "mid", "high"])}, "y").collect()} == {("low", 1, 1.0), ("mid", 1, 3.0), ("high", 2, 6.0)}


def test_canonical_records_and_adjusted_prices(spark):
    from tidemark.operators.series import adjust_forward
    from tidemark.sources.lake import canonical

    rows = [("o", 1, D(2024, 1, 1), "{}"), ("o", 2, None, "{}"), ("o", 3, D(2024, 1, 1), None), ("p", 4, None, "x")]
    got = canonical(spark.createDataFrame(rows, "dataset string, key long, day date, payload string"), spark.createDataFrame([(1,), (1,)], "key long"), "key", "dataset", "day").collect()
    assert [(r.key, r.invalid, r.source_hash) for r in got] == [(3, 1, None)]
    bars = [(1, D(2024, 1, 1), 1.0, 4.0, 1.0, 2.0, 1.0), (1, D(2024, 1, 2), 2.0, 8.0, 2.0, 4.0, 2.0), (2, D(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, None), (2, D(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0)]
    out = adjust_forward(spark.createDataFrame(bars, "code long, trade_date date, open double, high double, low double, close double, factor double")).collect()
    assert [tuple(r)[2:] for r in sorted(out)] == [(0.5, 2.0, 0.5, 1.0), (2.0, 8.0, 2.0, 4.0)]


def test_alpha_evidence_makes_no_rows_of_samples(spark):
    """Samples and lags are sums within a strategy's task: no rows are generated or joined, and rows are shuffled once."""
    df = spark.createDataFrame([], "s long, day date, ret double, mkt double, style double")
    plan = models.alpha_evidence(df, "s", "day", "ret", "mkt", ["style"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
