"""Quality by Bradley-Terry ranking: document scores from preference pairs of all labelled rows, then a threshold at a score quantile.

A pair says that a document labelled 1 is better than one labelled 0; the probability is the logistic function of the score
difference, and a score is linear in the document's features. The threshold is the quantile of training scores that equals the
share of label 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytetext import LOWER, NOT_SPACE, U64, Slice, mix, slices
from tidemark.llm.folds import held_out, sigmoid
from tidemark.llm.storage import materialize, release

#: predicted is 1 from this score on; the quantile threshold is mapped to it.
CUT = 0.3
#: Number of features of a text.
WIDTH = 17
#: Scores within +-REACH are dealt to a grid of POINTS when pairs are summed; the error of a pair's probability is below 1e-4.
REACH, STEP = 64, 1 / 16
POINTS = int(2 * REACH / STEP) + 1
_UPPER, _LOWER_CASE, _DIGIT, _MARK, _SYMBOL, _BEYOND = range(1, 7)
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[48:58], CLASS[128:] = _UPPER, _LOWER_CASE, _DIGIT, _BEYOND
CLASS[[ord(c) for c in ".,;:'-()\""]] = _MARK
CLASS[[ord(c) for c in "!#$%&*+/<=>?@[\\]^_`{|}~"]] = _SYMBOL


def features(part: Slice) -> np.ndarray:
    """Shares per text: letter case, digits, marks, symbols, other bytes, word length and its spread, repeated words and pairs, words that stand twice in a row, words in capitals, words without letters, lines and repeated lines, size."""
    off = part.offsets
    size = np.maximum(np.diff(off), 1).astype(float)
    cls = CLASS[part.data]
    share = []
    for c in (_UPPER, _LOWER_CASE, _DIGIT, _MARK, _SYMBOL, _BEYOND):
        sums = np.concatenate([[0], np.cumsum(cls == c)])
        share.append(sums)
    per_text = [(s[off[1:]] - s[off[:-1]]) / size for s in share]
    n = np.maximum(part.counts(), 1).astype(float)
    row = np.repeat(np.arange(part.rows), part.counts())
    length = (part.end - part.start).astype(float)
    mean = np.bincount(row, length, part.rows) / n
    spread = np.sqrt(np.maximum(np.bincount(row, length * length, part.rows) / n - mean * mean, 0))
    h = part.hashes()
    salt = mix(np.arange(part.rows, dtype=U64) + U64(1))
    distinct = lambda x, r: np.bincount(_first_of(x ^ salt[r], r), minlength=part.rows)
    unique = distinct(h, row) / n
    both = np.flatnonzero(row[1:] == row[:-1]) if len(row) > 1 else np.zeros(0, dtype=np.int64)
    pairs = distinct(mix(h[both] * U64(3) + h[both + 1]), row[both]) / np.maximum(n - 1, 1)
    twice = np.bincount(row[both[h[both] == h[both + 1]]], minlength=part.rows) / n
    upper, lower = share[0][part.end] - share[0][part.start], share[1][part.end] - share[1][part.start]
    letters = upper + lower + share[5][part.end] - share[5][part.start]
    capitals = np.bincount(row[(upper >= 2) & (lower == 0)], minlength=part.rows) / n
    symbols = share[4][part.end] - share[4][part.start]
    bare = np.bincount(row[letters == 0], minlength=part.rows) / n
    marked = np.bincount(row[symbols > 0], minlength=part.rows) / n
    # Lines, as hashes of their bytes.
    feed = np.flatnonzero(part.data == 10)
    begin = np.union1d(off[:-1][np.diff(off) > 0], feed + 1)
    begin = begin[begin < len(part.data)]
    line_row = np.searchsorted(off, begin, "right") - 1
    sums = np.zeros(len(part.data) + 1, dtype=U64)
    np.cumsum(mix(LOWER[part.data].astype(U64) * U64(257) + U64(1)) >> U64(20), out=sums[1:])
    line_end = np.append(begin[1:], len(part.data))
    lines = np.maximum(np.bincount(line_row, minlength=part.rows), 1)
    same = 1 - distinct(mix(sums[line_end] - sums[begin]), line_row) / lines
    out = [*per_text, mean, spread, unique, pairs, twice, capitals, bare, marked, same, np.log1p(part.counts()), lines / n]
    return np.column_stack(out)


def _first_of(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The row of one occurrence of each distinct value."""
    return row[np.unique(x, return_index=True)[1]] if len(x) else row


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float, slope: float):
        self.mean, self.scale, self.weights, self.threshold, self.slope = mean, scale, weights, threshold, slope

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([z, np.minimum(z * z, 16)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights

    def scores(self, text: pa.Array) -> np.ndarray:
        """The score threshold is mapped to CUT."""
        out = [np.zeros(0)]
        for part in slices(text, NOT_SPACE, False):
            out.append(sigmoid(self.slope * (self.raw(features(part)) - self.threshold) + np.log(CUT / (1 - CUT))))
        return np.concatenate(out)


def _feature_rows(batches):
    for batch in batches:
        for part in slices(batch.column(1), NOT_SPACE, False):
            x = features(part)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.row, part.rows), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["id", "x"])


def _parts(batches):
    """(x, y) of each batch of rows (x, y)."""
    for batch in batches:
        if batch.num_rows:
            yield np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1), np.asarray(batch.column(1))


def _summed(rows: DataFrame, of_task) -> np.ndarray:
    """The sum over tasks of the array that ``of_task`` makes of a task's batches."""

    def run(batches):
        a = of_task(_parts(batches))
        if a is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a.size)), pa.array(a.ravel())], ["k", "v"])

    got = rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")
    return got["v"].to_numpy(dtype=float)


def _grid(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of scores on the grid: the point below and the share that goes to the one above."""
    at = (np.clip(s, -REACH, REACH) + REACH) / STEP
    low = np.minimum(at.astype(np.int64), POINTS - 2)
    return low, at - low


def _dealt(rows: DataFrame, model: Model) -> np.ndarray:
    """By label and point of the grid: the number of rows and the sums of their inputs. Each row is shared by the two points around its score."""

    def run(batches):
        width = len(model.weights) + 1
        out = np.zeros((2 * POINTS, width))
        for batch in batches:
            for x, y in _parts([batch]):
                z = np.column_stack([np.ones(len(x)), model.inputs(x)])
                low, up = _grid(z[:, 1:] @ model.weights)
                for at, share in ((low, 1 - up), (low + 1, up)):
                    place = (y == 1) * POINTS + at
                    used, place = np.unique(place, return_inverse=True)
                    for j in range(width):
                        out[used, j] += np.bincount(place, share * z[:, j], len(used))
        used = np.flatnonzero(out[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(out[used, j]) for j in range(width))], ["k", *(f"v{j}" for j in range(width))])

    names = [f"v{j}" for j in range(len(model.weights) + 1)]
    got = rows.mapInArrow(run, "k long, " + ", ".join(f"{n} double" for n in names)).groupBy("k").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    out = np.zeros((2 * POINTS, len(names)))
    out[got["k"].to_numpy()] = got[names].to_numpy()
    return out.reshape(2, POINTS, -1)


def _curvature(rows: DataFrame, model: Model, bend: np.ndarray) -> np.ndarray:
    """Sum of the products of the inputs, weighted by ``bend`` (label, point of the grid)."""
    width = len(model.weights)

    def of_task(parts):
        out = None
        for x, y in parts:
            z = model.inputs(x)
            low, up = _grid(z @ model.weights)
            label = (y == 1).astype(int)
            w = bend[label, low] * (1 - up) + bend[label, low + 1] * up
            got = (z * w[:, None]).T @ z
            out = got if out is None else out + got
        return out

    return _summed(rows, of_task).reshape(width, width)


def _ordered(scores: DataFrame, places: dict[str, tuple[int | None, int]]) -> dict[str, float]:
    """The value at each place (from 0) in ascending order, of one label's scores or of all (None): ranges are counted in 1,024 parts and the part that
    holds the place is counted anew until it holds one value."""
    ends = scores.groupBy("y").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).toPandas().set_index("y")
    some = {k: ends if label is None else ends.loc[[label]] for k, (label, _) in places.items()}
    ranges = {k: (float(e["lo"].min()), float(e["hi"].max()), places[k][1]) for k, e in some.items()}
    while any(lo < hi for lo, hi, _ in ranges.values()):
        ask = []
        for k, (lo, hi, _) in ranges.items():
            if lo < hi:
                mine = F.col("s").between(lo, hi) if places[k][0] is None else F.col("s").between(lo, hi) & (F.col("y") == places[k][0])
                part = F.least(F.lit(1023), F.floor((F.col("s") - lo) * F.lit(1024 / (hi - lo)))).cast("int")
                ask.append(F.when(mine, F.struct(F.lit(k).alias("k"), part.alias("part"))))
        got = scores.select("s", F.explode(F.array_compact(F.array(*ask))).alias("a")).groupBy("a.k", "a.part").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).toPandas()
        for k, mine in got.sort_values("part").groupby("k"):
            place = ranges[k][2]
            before = mine["n"].cumsum().to_numpy()
            i = int(np.searchsorted(before, place, "right"))
            ranges[k] = (float(mine["lo"].iloc[i]), float(mine["hi"].iloc[i]), place - int(before[i - 1] if i else 0))
    return {k: lo for k, (lo, _, _) in ranges.items()}


def _score_of(model: Model):
    def run(batches):
        for batch in batches:
            for x, y in _parts([batch]):
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(x)), pa.array(y)], ["s", "y"])

    return run


def fit_pairs(rows: DataFrame, pairs: int = 60_000, ridge: float = 1.0) -> Model:
    """Newton's method for the mean logistic loss over all pairs of a better and a worse row of (x, y), times ``pairs``, with a ridge.

    A pair counts by its two scores only, so the sums over all pairs follow from the rows as dealt to a grid of scores; no pair is made, and the driver
    sees sums of the grid's points alone.
    """
    size = F.size("x")
    if (width := rows.select(F.max(size)).first()[0]) is None:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(2 * WIDTH), 0.0, 1.0)
    sums = rows.agg(*(f(F.col("x")[j]).alias(f"{n}{j}") for j in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    model = Model(np.array([sums[f"m{j}"] for j in range(width)]), np.array([sums[f"s{j}"] for j in range(width)]) + 1e-6, np.zeros(2 * width), 0.0, 1.0)
    count = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_bad, n_good = count.get(0, 0), count.get(1, 0)
    if not n_bad or not n_good:
        return model
    rows = rows.where("y in (0, 1)")
    points = np.arange(POINTS) * STEP
    share = pairs / (n_bad * n_good)
    for _ in range(40):
        bad, good = _dealt(rows, model)
        i, j = np.flatnonzero(good[:, 0]), np.flatnonzero(bad[:, 0])
        p = sigmoid(points[j][None, :] - points[i][:, None])
        bent = p * (1 - p)
        pull = good[i, 1:].T @ (p @ bad[j, 0]) - bad[j, 1:].T @ (p.T @ good[i, 0])
        bend = np.zeros((2, POINTS))
        all_points = points[:, None]
        for label, other in ((0, good), (1, bad)):
            at = np.flatnonzero(other[:, 0])
            q = sigmoid(points[at][None, :] - all_points)
            bend[label] = (q * (1 - q)) @ other[at, 0]
        cross = good[i, 1:].T @ bent @ bad[j, 1:]
        curve = _curvature(rows, model, bend) - cross - cross.T
        step = np.linalg.solve(share * curve + ridge * np.eye(2 * width), share * pull - ridge * model.weights)
        model.weights = model.weights + step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    # Sums of doubles differ in their last digits by the order of rows.
    model.weights = np.round(model.weights, 5)
    scores = materialize(rows.mapInArrow(_score_of(model), "s double, y int"), "quality_scores")
    n = n_bad + n_good
    middle = {f"{name}{k}": (label, (m - 1 + k) // 2) for name, label, m in (("bad", 0, n_bad), ("good", 1, n_good)) for k in (0, 1)}
    at = _ordered(scores, {"below": (None, n_bad - 1), "above": (None, min(n_bad, n - 1)), **middle})
    release(scores)
    model.threshold = (at["below"] + at["above"]) / 2
    apart = (at["good0"] + at["good1"] - at["bad0"] - at["bad1"]) / 2
    model.slope = 4 / (apart + 1e-9) if apart > 0 else 1.0
    return model


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(x, y) of every labelled row outside the held-out fold. Ids with several labels take the largest one; null ids, labels and texts teach nothing.
    Texts are not shuffled, only their features."""
    have = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(~held_out("id")).dropna()
    have = have.groupBy("id").agg(F.max("y").alias("y"))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(~held_out("id")).dropna()
    return src.mapInArrow(_feature_rows, "id long, x array<double>").join(have, "id").select("x", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from all labelled rows outside the held-out fold. Without both labels every score is the cut itself."""
    rows = materialize(labelled(docs, labels, id_col, text_col, label_col), "quality_rows")
    model = fit_pairs(rows)
    release(rows)
    return model


def _score_rows(model: Model):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))], ["id", "score"])

    return run


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score in [0, 1] and predicted (score >= 0.3) of each input row, repeated rows included. Null texts are scored
    as empty ones. Null ids stay null and count as held out. Other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(_score_rows(model), "id long, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
