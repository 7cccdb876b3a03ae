"""Jobs with keyed state: several batches and a restart give what the batch operators give over the whole log."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import lake
from tidemark.streaming import books, jobs

D = dt.date
LEDGER = "account long, code string, event_id string, day date, type string, quantity double, price double, fee double, ref string"


def turns(spark, rows, schema, run, cuts=2):
    """Run a stream over consecutive parts of the rows, each time anew from its checkpoint."""
    folder, root = lake.scratch(spark, "in"), lake.scratch(spark, "out")
    size = -(-len(rows) // cuts)
    parts = [spark.createDataFrame(rows[i : i + size], schema) for i in range(0, len(rows), size)]
    return jobs.in_turns(parts, folder, lambda: run(jobs.stream(spark, folder), root))


@pytest.fixture(autouse=True)
def state(spark):
    books.keyed_state(spark)


def test_golden_ledger(spark):
    e = lambda i, kind, code="A", quantity=0.0, price=0.0, fee=0.0, ref=None: (1, code, f"{i:02d}", D(2024, 1, 1), kind, quantity, price, fee, ref)
    rows = [e(1, "buy", quantity=100.0, price=10.0, fee=1.0), e(2, "suspension"), e(3, "sell", quantity=20.0, price=11.0, fee=1.0), e(4, "charge", price=5.0), e(5, "record", price=0.1), e(6, "pay", ref="05")]
    rows += [e(7, "split", quantity=1.1), e(8, "rights", quantity=0.1, price=5.0), e(9, "swap", quantity=0.5, ref="B"), e(1, "buy", quantity=100.0, price=10.0, fee=1.0)]
    run = lambda df, root: jobs.run_to_table(books.ledger_stream(df, ["account"], ["event_id"], 10000.0, limited=True), root, "append", ["account"])
    got = turns(spark, rows, LEDGER, run, cuts=3).first()
    assert (got.cash, got.fees, got.events, got.receivable) == pytest.approx((9177.0, 7.0, 9, 0.0))
    assert (got.held, got.nav) == pytest.approx((48.4, 10145.0))
    # Rights that the cash does not pay for are not taken.
    poor = turns(spark, rows[:1] + [e(8, "rights", quantity=9.0, price=50.0)], LEDGER, run).first()
    assert (poor.held, poor.cash) == (100.0, 8999.0)


def log(seed):
    rng = random.Random(seed)
    rows, records = [], []
    for i in range(500):
        kind = rng.choice(["buy", "buy", "sell", "dividend", "tax", "charge", "split", "rights", "swap_in", "swap_out", "record", "pay", "note"])
        account = rng.choice([0, 0, 0, 1, 2])
        ref = rng.choice(records)[1] if kind == "pay" and records else None
        account = next((a for a, r in records if r == ref), account)
        if kind == "record":
            records.append((account, f"e{i:04d}"))
        quantity = {"split": rng.choice([2.0, 0.5]), "rights": 0.1}.get(kind, float(rng.randrange(1, 40)))
        rows.append((account, "A", f"e{i:04d}", D(2024, 1, 1) + dt.timedelta(days=i // 2), kind, quantity, 1.0 + i % 7, 0.5, ref))
    return rows + rows[100:160]  # some come again in the last batch


def test_ledger_stream_equals_the_batch_operator(spark):
    rows = log(7)
    run = lambda df, root: jobs.run_to_table(books.ledger_stream(df, ["account"], ["day", "event_id"], 500.0), root, "append", ["account"])
    got = {r.account: r for r in turns(spark, rows, LEDGER, run, cuts=3).collect()}
    want = jobs.replay_ledger(spark.createDataFrame(rows, LEDGER), ["account"], ["day", "event_id"], 500.0).collect()
    assert len(want) == 3
    for w in want:
        g = got[w.account]
        assert [g[c] for c in ("cash", "held", "fees", "events", "receivable", "nav")] == pytest.approx([w[c] for c in ("cash", "held", "fees", "events", "receivable", "nav")])


def test_lots_stream_equals_the_batch_operator(spark):
    rows = log(9)
    run = lambda df, root: jobs.run_to_table(books.lots_stream(df, ["account"], ["day", "event_id"]), root, "append", ["account", "lot"])
    got = sorted((r.account, r.acquired, round(r.quantity, 6), r.sellable) for r in turns(spark, rows, LEDGER, run, cuts=3).where("quantity > 0").collect())
    batch = jobs.fifo_lots(spark.createDataFrame(rows, LEDGER).where("type in ('buy', 'sell')"), ["account"], ["day", "event_id"])
    assert got == sorted((r.account, r.acquired, round(r.quantity, 6), r.sellable) for r in batch.collect())


def test_settled_lots_are_sold_from_the_next_day_on(spark):
    e = lambda i, day, kind, quantity: (1, "A", f"e{i}", D(2024, 1, day), kind, quantity, 1.0, 0.0, None)
    rows = [e(1, 1, "buy", 10.0), e(2, 2, "buy", 5.0), e(3, 2, "sell", 12.0)]
    run = lambda df, root: jobs.run_to_table(books.lots_stream(df, ["account"], ["day", "event_id"], settled=True), root, "append", ["account", "lot"])
    assert [(r.acquired, r.quantity) for r in turns(spark, rows, LEDGER, run).where("quantity > 0").collect()] == [(D(2024, 1, 2), 5.0)]


def test_decayed_scores_equal_a_sum_over_unexpired_events(spark):
    rng = random.Random(3)
    at = sorted(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(0, 40 * 86400)) for _ in range(300))
    rows = [(rng.randrange(3), t, rng.uniform(-5, 5), rng.choice([7, 14, 30])) for t in at if not (dt.datetime(2024, 1, 5) < t < dt.datetime(2024, 1, 20))]
    rows.append((9, dt.datetime(2024, 1, 2, 5), 1.0, 7))  # falls silent and expires
    rows.append((0, dt.datetime(2024, 2, 15), 1.0, 7))
    run = lambda df, root: jobs.run_to_table(books.decayed_scores(df, ["user"], "ts", "score", "horizon", "1 hour"), root, "append")
    got = {(r.user, r.step): (r.score, r.events) for r in turns(spark, sorted(rows, key=lambda r: r[1]), "user long, ts timestamp, score double, horizon int", run, cuts=3).collect()}
    want = {}
    for n in range(1, 46):
        step = dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
        for user in (0, 1, 2, 9):
            live = [(s, (step - t).total_seconds() / 86400, h) for u, t, s, h in rows if u == user and t < step <= dt.datetime(t.year, t.month, t.day) + dt.timedelta(days=h)]
            if live and step <= dt.datetime(2024, 2, 14, 23):
                want[user, step.date()] = (sum(s * math.pow(0.5, a / max(2, h / 2)) for s, a, h in live), len(live))
    assert set(got) == set(want)
    for k, (score, events) in want.items():
        assert got[k][1] == events and got[k][0] == pytest.approx(score)


def test_upsert_keeps_what_is_known_and_late_rows_are_told_apart(spark):
    rows = [("a", 1), ("b", 2), ("b", 3), ("a", 4), ("c", 5), ("b", 6)]
    got = turns(spark, rows, "k string, n long", lambda df, root: jobs.upsert_new(df, root, "k", "n"), cuts=3)
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 2), ("c", 5)]
    days = [D(2024, 3, 1), D(2024, 1, 1), D(2024, 2, 1), D(2024, 1, 20), D(2024, 2, 29), None]
    got = turns(spark, [(i, d) for i, d in enumerate(days)], "i long, day date", lambda df, root: jobs.split_late(df, root, "day", "20 days"), cuts=3)
    assert {r.i: r.late for r in got.collect()} == {0: False, 1: False, 2: True, 3: True, 4: False, 5: False}


def test_feeds_have_their_own_limits(spark):
    rows = [("x", dt.datetime(2024, 1, 1)), ("x", dt.datetime(2024, 1, 2)), ("y", dt.datetime(2024, 1, 1)), ("z", dt.datetime(2024, 1, 1))]
    policy = spark.createDataFrame([("x", 5), ("y", 7)], "feed string, limit int")
    run = lambda df, root: jobs.run_to_table(jobs.freshness(df, policy, "feed", "ts"), root, "update", ["feed", "limit"])
    assert sorted((r.feed, r.limit, r.last_at) for r in turns(spark, rows, "feed string, ts timestamp", run).collect()) == [("x", 5, dt.datetime(2024, 1, 2)), ("y", 7, dt.datetime(2024, 1, 1))]


def test_told_and_open_sessions_make_all_sessions(spark):
    rng = random.Random(11)
    rows = sorted((rng.randrange(4), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(0, 3000))) for _ in range(120))
    rows = sorted(rows, key=lambda r: r[1]) + [(7, dt.datetime(2024, 1, 3, 1, 59)), (8, dt.datetime(2024, 1, 3, 2, 0)), (8, dt.datetime(2024, 1, 3, 2, 20))]
    schema = "user long, ts timestamp"
    closed = turns(spark, rows, schema, lambda df, root: jobs.run_to_table(jobs.sessions(df, "ts", "user", "30 minutes"), root, "append"), cuts=3)
    told = closed.count()
    got = jobs.with_open_sessions(closed, spark.createDataFrame(rows, schema), "ts", "user", "30 minutes")
    want = []
    for u in {r[0] for r in rows}:
        at = sorted(t for v, t in rows if v == u)
        for t in at:
            if want and want[-1][0] == u and t <= want[-1][2]:
                want[-1] = (u, want[-1][1], t + dt.timedelta(minutes=30), want[-1][3] + 1)
            else:
                want.append((u, t, t + dt.timedelta(minutes=30), 1))
    assert sorted((r.user, r.start, r.end, r.n) for r in got.collect()) == sorted(want) and 0 < told < len(want)


def test_keys_share_state_and_long_queues_are_paged(spark, monkeypatch):
    monkeypatch.setattr(books, "BUCKETS", 2)
    monkeypatch.setattr(books, "PAGE", 3)
    rng = random.Random(5)
    rows = []
    for i in range(240):
        kind = "buy" if i < 120 else rng.choice(["buy", "sell", "sell"])
        rows.append((rng.choice([0, 1, 2, 3, None]), "A", f"e{i:04d}", D(2024, 1, 1) + dt.timedelta(days=i // 4), kind, float(rng.randrange(1, 40)), 1.0, 0.5, None))
    run = lambda df, root: jobs.run_to_table(books.lots_stream(df, ["account"], ["day", "event_id"]), root, "append", ["account", "lot"])
    got = turns(spark, rows, LEDGER, run, cuts=4).where("quantity > 0").collect()
    want = {}
    for account, _, _, day, kind, quantity, *_ in rows:
        queue = want.setdefault(account, [])
        if kind == "buy":
            queue.append([day, quantity])
        while kind == "sell" and quantity > 0 and queue:
            take = min(queue[0][1], quantity)
            queue[0][1], quantity = queue[0][1] - take, quantity - take
            if queue[0][1] <= 1e-9:
                queue.pop(0)
    side = lambda x: sorted(x, key=str)
    assert side((r.account, r.acquired, r.quantity) for r in got) == side((a, d, q) for a, queue in want.items() for d, q in queue)
    run = lambda df, root: jobs.run_to_table(books.ledger_stream(df, ["account"], ["day", "event_id"], 500.0), root, "append", ["account"])
    held = {r.account: r.held for r in turns(spark, rows, LEDGER, run, cuts=4).collect()}
    assert held == {a: pytest.approx(sum(q for _, q in queue)) for a, queue in want.items()}


def test_orders_share_buckets_of_state(spark):
    folder = lake.scratch(spark, "in")
    spark.range(3).selectExpr("id as order_id", "id as sequence", "id as broker_sequence", "'filled' as event_type", "cast(id as string) as external_id").write.parquet(folder)
    x = books.order_stream(jobs.stream(spark, folder), ["order_id"], ["external_id"])
    assert x.isStreaming and "key_bucket" in x._jdf.queryExecution().logical().toString()
