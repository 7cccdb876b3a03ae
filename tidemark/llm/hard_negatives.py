"""Hard negatives by a vertical scan of decomposed vectors (BOND).

Vectors are dealt into blocks by a hash of their id and stored by column: a block has a row for each dimension with all its values
and their smallest and largest. Anchors are dealt into blocks too, and every block of anchors meets every block of columns in a group
of its own, so that no task holds more than one of each. There an anchor reads columns in the order of its own components'
magnitude. What the columns not yet read can add at least and at most bounds each candidate's score; candidates that cannot reach the
block's first positives, or any window of scores, leave the candidate set. Scores are integers, so that what is left is exact.

The first pass finds the positives. They set the windows of the second one, which finds the negatives in them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.clustering import integer_vectors
from tidemark.llm.storage import materialize

#: Vectors of a block of columns, and anchors that meet it at once.
ROW_BLOCK = 8192
ANCHOR_BLOCK = 4096
#: Columns read between two looks at the bounds.
STEP = 8
#: Scores stay below this, so that they are exact in double precision.
LARGEST_SCORE = 1 << 52


def _columns(key: tuple, table: pa.Table) -> pa.Table:
    """A block's rows as one row per dimension, and a row (dimension -1) with ids and labels."""
    table = table.combine_chunks()
    n, block = table.num_rows, key[0].as_py()
    x = table["v"].combine_chunks().flatten().to_numpy().reshape(n, -1).T
    dims = len(x)
    none = [None] * dims
    return pa.table(
        {
            "block": pa.array([block] * (dims + 1), pa.int64()),
            "dim": pa.array(range(-1, dims), pa.int32()),
            "values": pa.array([None, *x], pa.list_(pa.int32())),
            "ids": pa.array([table["id"].to_numpy(), *none], pa.list_(pa.int64())),
            "labels": pa.array([table["label"].to_pylist(), *none], pa.list_(pa.string())),
        }
    )


class Block:
    """A block of columns with the bounds of each."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks().sort_by("dim")
        self.ids = table["ids"][0].values.to_numpy()
        self.labels = table["labels"][0].values.dictionary_encode()
        self.x = np.stack([table["values"][i].values.to_numpy() for i in range(1, table.num_rows)]).astype(np.float64)
        self.low, self.high = self.x.min(axis=1), self.x.max(axis=1)

    def of_label(self, label: str) -> np.ndarray:
        """Which rows have the label."""
        at = self.labels.dictionary.index(label).as_py()
        return self.labels.indices.to_numpy() == at

    def scan(self, q: np.ndarray, rows: np.ndarray, stay: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The rows that ``stay`` never sent away by their lower and upper bounds, with their scores."""
        order = np.argsort(-np.abs(q), kind="stable")
        least = np.minimum(q * self.low, q * self.high)[order]
        most = np.maximum(q * self.low, q * self.high)[order]
        # What the columns from each on can add.
        least, most = (np.append(np.cumsum(v[::-1])[::-1], 0.0) for v in (least, most))
        score = np.zeros(len(rows))
        for at in range(0, len(q), STEP):
            read = order[at : at + STEP]
            score += q[read] @ (self.x[read][:, rows] if len(rows) < self.x.shape[1] else self.x[read])
            end = min(at + STEP, len(q))
            keep = stay(score + least[end], score + most[end])
            if not keep.all():
                rows, score = rows[keep], score[keep]
            if not len(rows):
                break
        return rows, score.astype(np.int64)

    def first(self, rows: np.ndarray, score: np.ndarray, many: int) -> np.ndarray:
        """The best places in ``rows``: higher scores first, then smaller ids."""
        return np.lexsort((self.ids[rows], -score))[:many]


def _anchors(table: pa.Table) -> Iterator[tuple[int, str, np.ndarray, list | None]]:
    wins = table["windows"].to_pylist() if "windows" in table.column_names else [None] * table.num_rows
    for i, label, v, w in zip(table["id"].to_pylist(), table["label"].to_pylist(), table["v"].to_pylist(), wins, strict=True):
        yield i, label, np.array(v, dtype=np.float64), w


def _positives(many: int):
    """The first rows of the anchor's label in one block."""

    def best(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        if len(lower) <= many:
            return np.ones(len(lower), dtype=bool)
        return upper >= np.partition(lower, len(lower) - many)[len(lower) - many]

    def run(columns: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if columns.num_rows and anchors.num_rows:
            block = Block(columns)
            for anchor, label, q, _ in _anchors(anchors):
                rows, score = block.scan(q, np.flatnonzero(block.of_label(label) & (block.ids != anchor)), best)
                out += [(anchor, int(block.ids[rows[i]]), int(score[i])) for i in block.first(rows, score, many)]
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("anchor", "id", "score"))})

    return run


def _negatives(many: int):
    """The first rows of other labels in one block for each window [low, high] of scores of an anchor."""

    def run(columns: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if columns.num_rows and anchors.num_rows:
            block = Block(columns)
            for anchor, label, q, windows in _anchors(anchors):
                least, most = min(w["low"] for w in windows), max(w["high"] for w in windows)
                rows, score = block.scan(q, np.flatnonzero(~block.of_label(label)), lambda lower, upper, a=least, b=most: (upper >= a) & (lower <= b))
                for w in windows:
                    inside = np.flatnonzero((score >= w["low"]) & (score <= w["high"]))
                    out += [(anchor, w["positive"], int(block.ids[rows[i]]), int(score[i])) for i in inside[block.first(rows[inside], score[inside], many)]]
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("anchor", "positive", "id", "score"))})

    return run


def mine_hard_negatives(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256
) -> DataFrame:
    """For each anchor (rows that fulfil ``anchors``, a condition on the columns of ``vectors``) and each of its first ``positives`` rows of the same
    label, the first ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Scores are inner products of floor(``scale`` * x);
    higher ones come first, then smaller ids.

    Rows with a null id, label or vector, with null or non-finite components, or with another number of components than most rows
    have (of equally frequent numbers the smallest) take no part, nor do rows with integers so large that scores could exceed 2**52
    (2**23 with 64 components). Rows that repeat an id count once, with the smallest label and vector. Anchors without positives and
    windows without rows give nothing; an empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("x"), anchors.alias("anchor"))
    src = src.where("id is not null and label is not null and x is not null")
    finite = integer_vectors(F.col("x"), F.size("x"), scale, LARGEST_SCORE)[1]
    sizes = src.where(F.size("x") > 0).where(finite).groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    values, good = integer_vectors(F.col("x"), sizes[0].n, scale, min(1 << 30, math.isqrt(LARGEST_SCORE // sizes[0].n)))
    rows = src.where(good).groupBy("id").agg(F.min(F.struct("label", values.alias("v"), "anchor")).alias("r")).select("id", "r.label", "r.v", F.coalesce("r.anchor", F.lit(False)).alias("anchor"))
    rows = materialize(rows, "vectors")
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a")).first()
    blocks, groups = -(-count.n // ROW_BLOCK), max(1, -(-count.a // ANCHOR_BLOCK))
    stored = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "label", "v").groupBy("block")
    stored = materialize(stored.applyInArrow(_columns, "block long, dim int, values array<int>, ids array<long>, labels array<string>"), "columns")
    dealt = stored.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asked = rows.where("anchor").select(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(groups)).alias("group"), "id", "label", "v")

    def meet(queries: DataFrame, job: Callable, schema: str) -> DataFrame:
        return dealt.groupBy("group", "block").cogroup(queries.withColumn("block", every).groupBy("group", "block")).applyInArrow(job, schema)

    found = meet(asked, _positives(positives), "anchor long, id long, score long")
    place = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    found = materialize(found.withColumn("place", place).where(F.col("place") <= positives), "positives")
    # 100 * negative lies between low * positive and high * positive.
    floor = lambda n: f"({n} - pmod({n}, 100L)) div 100"
    window = F.struct(F.col("id").alias("positive"), F.expr("-" + floor(f"(-{low}L * score)")).alias("low"), F.expr(floor(f"({high}L * score)")).alias("high"))
    windows = found.select("anchor", window.alias("w")).where("w.low <= w.high").groupBy("anchor").agg(F.sort_array(F.collect_list("w")).alias("windows"))
    again = asked.join(windows, F.col("id") == F.col("anchor")).drop("anchor")
    hits = meet(again, _negatives(negatives), "anchor long, positive long, id long, score long")
    rank = F.row_number().over(W.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id"))
    hits = hits.withColumn("rank", rank).where(F.col("rank") <= negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    own = found.select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    out = hits.join(own, ["anchor", "positive"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", "negative_id", "positive_score", "negative_score")
