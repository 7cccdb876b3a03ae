"""Stocks of an account are sought by bounds of their buckets and summed by their own weights."""

import random

from tidemark.operators import portfolio


def test_no_stock_is_lost_when_buckets_are_shared(spark, monkeypatch):
    """Few buckets, so that stocks share them: all kinds equal a plain loop. Funds without holdings count in an account's total; sums of buckets stand for stocks."""
    monkeypatch.setattr(portfolio, "BUCKETS", 8)
    kept = {}
    write = portfolio.written
    monkeypatch.setattr(portfolio, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    rng = random.Random(5)
    p = [(a, f, rng.choice([5.0, 20.0, 300.0])) for a in range(12) for f in rng.sample(range(14), 2 + a % 9)] + [(99, 1, -5.0), (98, 2, 0.0), (97, 3, 1e-9)]
    h = [(f, i, rng.random() / 8) for f in range(12) for i in rng.sample(range(50), 15)] + [(5, 100, 0.0), (5, 101, None)]
    g = [(f, n, rng.random() / 2) for f in range(12) for n in "xyz"]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows = portfolio.exposure_signals(frame(p, "account long, fund long, value double"), frame(h, "fund long, item long, weight double"), frame(g, "fund long, industry string, weight double")).collect()
    got = {(r.account, r.kind, r.subject): (r.level, round(r.exposure, 9), r.funds) for r in rows}
    want = {}
    for a in {a for a, _, _ in p}:
        total = sum(v for b, _, v in p if b == a)
        if total <= 0:
            continue
        for is_stock, table in ((True, h), (False, g)):
            sums = {}
            for _, f, v in (x for x in p if x[0] == a):
                for fund, s, w in table:
                    if fund == f:
                        e = sums.setdefault(str(s), [0.0, 0])
                        e[0] += v / total * (w or 0.0)
                        e[1] += 1
            for s, (e, n) in sums.items():
                if is_stock and e >= 0.05:
                    want[a, "stock_exposure", s] = ("risk" if e >= 0.1 else "warning", round(e, 9), n)
                if is_stock and e >= 0.02 and n >= 2:
                    want[a, "overlap", s] = ("warning", round(e, 9), n)
                if not is_stock and e >= 0.2:
                    want[a, "industry", s] = ("risk" if e >= 0.35 else "warning", round(e, 9), n)
    assert len(rows) == len(got) and got == want and {k for _, k, _ in want} == {"stock_exposure", "overlap", "industry"}
    assert {r.key for r in kept["reached"].where("kind = 0").collect()} <= set(range(8))
