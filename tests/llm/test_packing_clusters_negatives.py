"""Packing as an exact round trip, clusters and hard negatives against brute force."""

import functools
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as H
from tidemark.llm import packing as P
from tidemark.llm import queries as Q
from tidemark.llm.clustering import Centroids, choose_pivots, cluster_vectors, squared

FILE = f"{Q.TOKENIZERS}/byte_bpe_50k.json"


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def plain_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


def odd_texts(seed):
    rng = random.Random(seed)
    parts = ["word", " ", "  ", "\n", "\n\n", " \n", "\t", "don't", "'s", "é", "ß ü", " ", "　", " ", "日本 語", "🙂", "12 345", "...", "<|endoftext|>", "á", "\x85", "\r\n", "x" * 50]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(400)]


def test_ids_equal_whole_encoding():
    import pyarrow as pa

    texts = [*odd_texts(1), "", " ", "word " * 5000]
    got = []
    encoder = P.Encoder(open(FILE, "rb").read())
    for _, ids, first in encoder.encode(pa.array(texts)):
        got += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [plain_ids(t)[:-1] for t in texts]


def check(rows, texts, size):
    """Every token of every document stands once; sequences have no gap and are no longer than ``size``."""
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded_to))
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for parts in by_seq.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size and all(p == (at if at & (at - 1) == 0 else size) for _, _, p in parts)
    for doc, text in texts.items():
        ids, at = np.array(plain_ids(text), dtype="<u4"), 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return len(by_seq)


@pytest.mark.parametrize("size", [2048, 32, 8])
def test_packing_round_trip(spark, size):
    texts = dict(enumerate([*odd_texts(2)[:200], None, "", None, "long word here " * 3000]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("task", F.lit(1)).repartition(5)
    check(P.pack_documents(docs, FILE, size=size).collect(), texts, size)


def test_packing_of_whole_table(spark):
    rows = Q.op11_packing(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in Q.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    n = check(rows, texts, 2048)
    assert sum(r.length for r in rows) > 0.98 * 2048 * n


def test_packing_repeats_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 30 + [(None, "d e")] * 3 + [(2, None)], "doc_id long, text string")
    rows = P.pack_documents(docs, FILE, size=16).collect()
    assert len(rows) == 34 and sum(r.doc_id is None for r in rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 34
    assert P.pack_documents(docs.limit(0), FILE).count() == 0


def test_shortest_pack_first_equals_one_by_one():
    rng = random.Random(4)
    for _ in range(30):
        size = rng.choice([10, 64])
        lengths = [rng.randrange(1, size) for _ in range(rng.randrange(1, 300))]
        packs = []
        for n in sorted(lengths, reverse=True):
            best = min(packs, key=sum, default=None)
            if best is None or sum(best) + n > size:
                packs.append([n])
            else:
                best.append(n)
        histogram = {n: lengths.count(n) for n in set(lengths)}
        got = P.shortest_pack_first(histogram, size)
        assert sorted(sum(a * b for a, b in runs) for runs, count in got for _ in range(count)) == sorted(map(sum, packs))
        assert {n: sum(m * c for runs, c in got for k, m in runs if k == n) for n in histogram} == histogram
    # A billion empty documents are dealt in patterns, not one by one.
    assert sum(c for _, c in P.shortest_pack_first({1: 10**9, 2000: 5}, 2048)) == 5 + math.ceil((10**9 - 5 * 48) / 2048)


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())[:k]
    cents = [v for _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for n in range(len(cents)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == n]
            if own:
                cents[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, *near(v)) for i, v in kept]
    inertia = {n: sum(d for _, d, m in out if m == n) for n in range(len(cents))}
    return sorted((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, d, n in out)


def vectors(seed, n, labels=4):
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(5, 64))
    x = (mid[rng.integers(0, 5, n)] + 0.4 * rng.normal(size=(n, 64))).astype(np.float32)
    x[n // 2 : n // 2 + 5] = x[0]
    return [(i, v.tolist(), int(rng.integers(0, labels))) for i, v in enumerate(x)]


def test_clusters_equal_brute_force(spark):
    rows = vectors(3, 300)
    bad = [(900, None, 1), (901, [1.0] * 63, 1), (902, [float("nan")] + [0.0] * 63, 1), (903, [float("inf")] + [0.0] * 63, 1), (904, [None] + [0.0] * 63, 1), (905, [], 1), (906, [3e38] + [0.0] * 63, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, cluster int").withColumn("far", F.lit(1))
    got = sorted(tuple(r) for r in cluster_vectors(df).collect())
    assert got == brute_clusters([r[:2] for r in rows])
    assert cluster_vectors(df.limit(0)).count() == 0


def test_clusters_of_few_repeated_and_unnamed_rows(spark):
    rows = [(1, [1.0] * 64)] * 20 + [(None, [2.0] * 64)] * 3 + [(2, [1.5] * 64)]
    got = cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=30).collect()
    assert len(got) == 24 and {r.distance for r in got} == {0} and sum(r.vec_id is None for r in got) == 3


def test_surviving_centroids_hold_the_nearest_one():
    rng = np.random.default_rng(5)
    x = rng.integers(-100, 100, (500, 64))
    x[100:150] = x[0]
    cents = np.concatenate([x[:7], x[:3], rng.integers(-(1 << 27), 1 << 27, (2, 64))])
    for pivots in (choose_pivots(x, 6), x[:1]):
        which, best = Centroids(cents, pivots).nearest(x, np.stack([squared(x, p) for p in pivots], axis=1))
        full = np.stack([squared(x, c) for c in cents], axis=1)
        assert (best == full.min(axis=1)).all() and (which == full.argmin(axis=1)).all()


def brute_negatives(rows, every, positives=5, negatives=5):
    ok = [(i, [math.floor(256 * float(x)) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, q, label in ok:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, y) for i, v, y in ok if i != a)
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            hit = [(i, -s) for s, i, y in scored if y != label and 80 * -p <= 100 * -s <= 100 * -p][:negatives]
            out += [(a, pid, k, i, -p, s) for k, (i, s) in enumerate(hit, 1)]
    return sorted(out)


@pytest.mark.parametrize(("rows_a_block", "anchors_a_block"), [(8192, 4096), (60, 7)])
def test_negatives_equal_brute_force(spark, monkeypatch, rows_a_block, anchors_a_block):
    monkeypatch.setattr(H, "ROW_BLOCK", rows_a_block)
    monkeypatch.setattr(H, "ANCHOR_BLOCK", anchors_a_block)
    rows = vectors(6, 400)
    bad = [(1000, None, 1), (1010, [1.0] * 64, None), (1020, [float("nan")] * 64, 1), (1030, [None] * 64, 1), (1050, [float("inf")] * 64, 2)]
    more = [(1040, [1.0] * 3, 1), (1060, [], 1), (None, [1.0] * 64, 1), (1070, [1e30] * 64, 1)]
    df = spark.createDataFrame(rows + bad + more + rows[:30], "vec_id long, embedding array<double>, label int").withColumn("block", F.lit(1)).withColumn("score", F.lit("x"))
    got = H.mine_hard_negatives(df, F.col("vec_id") % 10 == 0)
    want = brute_negatives(rows, 10)
    assert len(want) > 50 and sorted(tuple(r) for r in got.collect()) == want


def test_negatives_without_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "a"), (1, [-1.0, -2.0], "a"), (2, [0.0, 0.0], "b")], "vec_id long, embedding array<double>, label string")
    assert H.mine_hard_negatives(df, F.col("vec_id") == 0).count() == 0  # the only positive has a score below zero
    assert H.mine_hard_negatives(df, F.lit(False)).count() == 0
    assert H.mine_hard_negatives(df.limit(0), F.lit(True)).count() == 0
