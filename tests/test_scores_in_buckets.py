import datetime as dt

import pytest

from tidemark.sources import lake
from tidemark.streaming import books, jobs


def test_keys_share_state_and_missing_values_are_no_error(spark):
    books.keyed_state(spark)
    at = lambda day, hour=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)
    rows = [(f"k{i}" if i else None, at(i % 5, 12), 1.0 + i, 7) for i in range(40)] + [("k1", None, 5.0, 7), ("k2", at(0), 5.0, None), ("k3", at(20), None, 7), ("k3", at(300), 2.0, 7), ("z", at(310), 1.0, 7)]
    folder, root = lake.scratch(spark, "in"), lake.scratch(spark, "out")
    spark.createDataFrame(rows, "user string, ts timestamp, score double, horizon int").coalesce(1).write.parquet(folder)
    df = books.decayed_scores(jobs.stream(spark, folder), ["user"], "ts", "score", "horizon", "1 hour")
    assert "key_bucket" in df._jdf.queryExecution().analyzed().toString()
    got = {(r.user, (dt.datetime.combine(r.step, dt.time()) - at(0)).days): (r.score, r.events) for r in jobs.run_to_table(df, root, "append").collect()}
    want = {}
    for step in range(1, 310):
        for user in {r[0] for r in rows}:
            live = [(s or 0.0, (at(step) - t) / dt.timedelta(days=1)) for u, t, s, h in rows if u == user and t and h and t < at(step) <= dt.datetime.combine(t, dt.time()) + dt.timedelta(days=h)]
            if live:
                want[user, step] = (sum(s * 0.5 ** (a / 3.5) for s, a in live), len(live))
    assert set(got) == set(want) and all(got[k] == (pytest.approx(v), n) for k, (v, n) in want.items())
