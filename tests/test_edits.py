"""Edit distances in blocks against the plain recurrence."""

import random

import numpy as np
import pyarrow as pa

from tidemark.operators.edits import BLOCK, distances, within


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_distances_equal_the_plain_recurrence():
    rng = random.Random(1)
    pairs = []
    for _ in range(150):
        a = "".join(rng.choice("abcd e") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 128, 129, 192, 240])))
        b = list(a)
        for _ in range(rng.randrange(30)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "ab"])
        pairs.append((a, "".join(b)))
    got = distances(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]))
    assert got.tolist() == [plain(a, b) for a, b in pairs]
    many = distances(pa.array(["kitten"] * (BLOCK + 3)), pa.array(["sitting"] * (BLOCK + 3)))
    assert len(many) == BLOCK + 3 and np.all(many == 3)


def test_similar_rows_are_kept(spark):
    rows = [(0, 1, "alpha beta gamma", "alpha beta gamma", False), (0, 2, "alpha beta gamma", "alphabeta gammas", False), (0, 3, "alpha beta gamma", "omega psi chi phi", False), (0, 4, "alpha", "alphas", False), (0, 5, "alpha", "alpha beta gamma delta", True)]
    df = spark.createDataFrame(rows, "a long, b long, ta string, tb string, linked boolean")
    assert sorted(r.b for r in df.mapInArrow(within(0.76, 12), "a long, b long").collect()) == [1, 2, 5]
