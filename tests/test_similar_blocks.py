"""Similar titles are found block by block, and every pair can be told from copies and links."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa

from tidemark.operators import edits, text_events


def titles(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde fgh") for _ in range(rng.choice([12, 13, 20, 40, 63, 64, 65, 66, 100, 127, 128, 129, 130, 200, 240]))) for _ in range(12)]
    out = []
    while len(out) < n:
        t = list(rng.choice(base))
        for _ in range(int(rng.random() * 0.35 * len(t))):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(2)] = rng.choice(["", "x", "a b", "q"])
        t = " ".join("".join(t).split())[:240].strip()
        if len(t) >= 12:
            out.append(t)
    return out


def similar(x, y):
    limit = int(0.24 * max(len(x), len(y)) + 1e-9)
    return abs(len(x) - len(y)) <= limit and int(edits.distances(pa.array([x]), pa.array([y]))[0]) <= limit


def test_no_pair_of_a_block_is_lost(monkeypatch):
    t = titles(3, 220)
    a, (i, j) = pa.array(t), np.triu_indices(len(t), 1)
    size = np.array([len(x) for x in t])
    d = edits.distances(a.take(pa.array(i)), a.take(pa.array(j)))
    hit = (d > 0) & (d <= np.floor(0.24 * np.maximum(size[i], size[j]) + 1e-9))
    want = set(zip(i[hit].tolist(), j[hit].tolist()))
    assert len(want) > 100
    for tile, pairs in ((edits.TILE, edits.PAIRS), (7, 50)):
        monkeypatch.setattr(edits, "TILE", tile)
        monkeypatch.setattr(edits, "PAIRS", pairs)
        assert {(int(x), int(y)) for x, y in zip(*edits.similar_across(a, a, 0.76, True))} == want
    one, two = edits.similar_across(a.slice(0, 90), a.slice(90), 0.76, False)
    assert {(int(x), int(y) + 90) for x, y in zip(one, two)} == {(x, y) for x, y in want if x < 90 <= y}
    assert [len(x) for x in edits.similar_across(a, a.slice(0, 0), 0.76, False)] == [0, 0]


def test_all_pairs_follow_from_copies_and_links(spark, monkeypatch):
    """Copies of a title on one day and on near days; blocks of few titles. No two items that meet the rule are left out, and no others are in."""
    monkeypatch.setattr(text_events, "BLOCK", 5)
    rng = random.Random(8)
    kinds = [*titles(5, 14), "short", "a title of words", "so a title of words stands in it", "short one"]
    rows = [(i, rng.choice(kinds), dt.datetime(2024, 1, 1 + rng.randrange(7), rng.randrange(24))) for i in range(110)]
    rows += [(200, "short", None), (201, "short", None)]
    got = text_events.similar_pairs(spark.createDataFrame(rows, "news_id long, title string, published_at timestamp")).collect()
    stands = {i: i for i, _, _ in rows} | {r.b: r.a for r in got if r.kind == "copy"}
    links = {(r.a, r.b) for r in got if r.kind == "link"}
    assert len(links) == sum(r.kind == "link" for r in got) and links
    want = set()
    for a, x, s in rows:
        for b, y, t in rows:
            if a < b and s and t and abs((s.date() - t.date()).days) <= 2:
                short, long = sorted((x, y), key=len)
                if x == y or len(short) >= 14 and short in long or len(short) >= 12 and similar(x, y):
                    want.add((a, b))
    all_ = {(a, b) for a in stands for b in stands if a < b and (stands[a] == stands[b] or (min(stands[a], stands[b]), max(stands[a], stands[b])) in links)}
    assert all_ == want


def test_titles_are_shuffled_and_not_their_pairs(spark, monkeypatch):
    """Titles that share all their words but are not similar: what groups are dealt grows with titles, each once a group, and no candidate is written."""
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "theta", "kappa"]
    rows = [(i, " ".join(rng.sample(words, 8)), dt.datetime(2024, 1, 1)) for i in range(300)]
    kept = {}
    write = text_events.written
    monkeypatch.setattr(text_events, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    text_events.similar_pairs(spark.createDataFrame(rows, "news_id long, title string, published_at timestamp")).count()
    assert "candidates" not in kept and kept["dealt"].count() <= 300 and kept["blocks"].count() == 1
