import random

import pytest

from tidemark.streaming import jobs

KINDS = ["buy", "buy", "sell", "split", "rights", "dividend", "tax", "charge", "swap_in", "swap_out", "record"]


def events(spark):
    rng, rows = random.Random(9), []
    for account, n in (("small", 6), ("one", 1), ("big", 300), ("large", 41)):
        for i in range(n):
            kind = rng.choice(KINDS)
            quantity = rng.choice([0.5, 2.0]) if kind == "split" else 0.1 if kind == "rights" else float(rng.randint(1, 9))
            rows.append((account, f"{account}{i}", i % 500, kind, quantity, float(rng.randint(1, 20)) / 10, 0.5, None))
            if kind == "record" and i % 2:
                rows.append((account, f"{account}{i}p", i % 500 + 20, "pay", 0.0, 0.0, 0.0, f"{account}{i}"))
    df = spark.createDataFrame(rows + rows[:5], "account string, event_id string, i int, type string, quantity double, price double, fee double, ref string")
    return df.selectExpr("account", "event_id", "date_add(date'2020-01-01', i) AS day", "type", "quantity", "price", "fee", "ref")


@pytest.mark.parametrize("run", [
    lambda e: jobs.replay_ledger(e, ["account"], ["day", "event_id"], 100.0),
    lambda e: jobs.fifo_lots(e.where("type in ('buy', 'sell')"), ["account"], ["day", "event_id"]),
])
def test_large_and_small_keys_give_the_same(spark, monkeypatch, run):
    found = []
    for large in (0, 40, 100_000):
        monkeypatch.setattr(jobs, "LARGE", large)
        found.append(sorted((tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in run(events(spark)).collect()), key=str))
    assert found[0] == found[1] == found[2]
    assert {r[0] for r in found[0]} >= {"big", "large"}


def test_small_keys_are_not_joined_to_chunks(spark):
    one, _ = jobs.by_size(jobs.applied_once(events(spark), ["account"], ["day", "event_id"]), ["account"])
    plan = jobs.positions_after(one[0], ["account"], "day", ["day", "event_id"], one[1])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "LeftAnti" in plan
