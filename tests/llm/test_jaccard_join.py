import random

import pytest

from tidemark.llm import jaccard_join as J


def brute(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, min(len(w), 1)))})
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and any(100 * len(a & b) >= percent * len(a | b) and a and b for a in sets[x] for b in sets[y]):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def corpus(seed):
    """Near copies at many distances, short texts, one passage in a third of all texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = [rng.choice(words) for _ in range(14)]
    rows, base = [], []
    for i in range(110):
        if base and rng.random() < 0.6:
            t = list(rng.choice(base))
            for _ in range(rng.randrange(0, 4)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 6, 8, 9, 12, 20, 45, 90]))]
            if rng.random() < 0.35:
                p = rng.randrange(len(t) + 1)
                t[p:p] = passage
        base.append(t)
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize(("seed", "k", "percent", "whole"), [(1, 4, 85, 4), (2, 4, 85, 0), (3, 2, 80, 0), (4, 5, 80, 1e9)])
def test_components_match_brute_force(spark, monkeypatch, seed, k, percent, whole):
    monkeypatch.setattr(J, "WHOLE", whole)  # 0: as many sets as can be enter the join on whole sets
    rows = corpus(seed)
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent).collect()}
    assert got == brute(rows, k, percent)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, 9), (1, long, 9), (2, long.upper(), 9), (None, long, 9), (3, None, 9), (4, "", 9), (5, "one", 9), (6, "ONE", 9), (7, "w " * 3000, 9), (8, "w " * 2000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumnRenamed("n", "component")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect())
    assert got == [(-1, 37, None), (1, 37, 1), (1, 37, 1), (2, 37, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 1, 5), (7, 1, 7), (8, 1, 7)]


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_group_of_near_copies_in_which_few_pairs_link(spark):
    """Copies of one base at all distances around the threshold: most pairs do not link, some outsiders link only with each other."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(100)]
    rows = []
    for i in range(160):
        t = list(base)
        for p in rng.sample(range(100), rng.randrange(0, 9)):
            t[p] = rng.choice(words)
        if rows and rng.random() < 0.2:
            t = rng.choice(rows)[1].split()
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.15:
            t = t[rng.randrange(12) :] + [rng.choice(words) for _ in range(rng.randrange(12))]
        rows.append((1000 - i, " ".join(t)))
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 4, 85)
    assert 10 < len(set(got.values())) < 150


def test_pairs_by_differences_are_all_links_of_a_group(spark):
    """The prefix join on differences alone finds every link between two classes of a pivot's group, one of which does not link with the pivot."""
    rng = random.Random(3)
    p = frozenset(range(60))
    near = []
    for i in range(1, 90):
        gone, new = rng.sample(sorted(p), rng.randrange(0, 10)), [1000 + rng.randrange(25) for _ in range(rng.randrange(0, 9))]
        near.append((i, (p - set(gone)) | set(new)))
    linked = lambda x, y: 100 * len(x & y) >= 85 * len(x | y)
    rows = [(i, 0, linked(x, p), len(x), 60, sorted(x ^ p)) for i, x in near if x != p]
    df = spark.createDataFrame(rows, "a long, p long, linked boolean, n int, np int, apart array<long>")
    part = spark.createDataFrame([(0, 0), *((r[0], 0) for r in rows if r[2])], "rep long, component long")
    found = {(r.a, r.b) for r in J.difference_pairs(df, part, 85).collect()}
    sets, outside = dict(near), {r[0] for r in rows if not r[2]}
    want = {(a, b) for a in sets for b in sets if a < b and (a in outside or b in outside) and linked(sets[a], sets[b])}
    assert want and want <= found and len(found) < len(outside) * len(sets) / 4


def test_repeated_rows_are_compared_once(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text)] * 300 + [(2, text + " x")] * 300 + [(2, "other words stand here")]
    seen = []
    whole = J.verify
    monkeypatch.setattr(J, "verify", lambda *a, **k: seen.append(whole(*a, **k)) or seen[-1])
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 601 and {r.component_id for r in got} == {1}
    assert all(df.count() <= 4 for df in seen[-1:])


@pytest.mark.parametrize("seed", [5, 6])
def test_repeated_ids_of_differing_texts(spark, seed):
    rng = random.Random(seed)
    rows = [(i // 3 if rng.random() < 0.4 else i, t) for i, t in corpus(seed)]
    rows += rng.sample(rows, 40)
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 4, 85)
