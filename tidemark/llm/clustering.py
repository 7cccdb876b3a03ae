"""Lloyd's rounds on integer vectors with a table of pivot distances (LAESA).

Each vector is written once with its squared distances to a few fixed pivots. In every round the difference between a vector's and a
centroid's distance to a pivot bounds their own distance from below; the largest of these bounds rules centroids out, and only those
that survive get an exact distance in integers. Vectors never move: a task returns a count and a sum per centroid, so that a round
sends rows for centroids, not for vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize, release

#: Larger integers could give squared distances beyond 64 bits.
LARGEST = 1 << 27
#: Pivots, and how many vectors (those with the smallest hashes) they are chosen from.
PIVOTS = 12
PIVOT_POOL = 512
#: What square roots of 64-bit integers and their difference can be wrong by, and more.
ROUNDING = 1e-4
BIG = (1 << 63) - 1


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows (of x) to one vector or to as many rows (of y), exact."""
    d = x - y
    return (d * d).sum(axis=1)


def choose_pivots(pool: np.ndarray, many: int) -> np.ndarray:
    """Vectors far from each other: each next pivot is the one farthest from those chosen."""
    chosen, near = [0], squared(pool, pool[0])
    while len(chosen) < min(many, len(pool)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squared(pool, pool[chosen[-1]]))
    return pool[chosen]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


class Centroids:
    def __init__(self, rows: np.ndarray, pivots: np.ndarray):
        self.rows = rows
        self.to_pivots = np.sqrt(np.array([squared(pivots, c) for c in rows]))

    def nearest(self, x: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid, of equally near ones the smallest number."""
        root = np.sqrt(to_pivots)
        low = np.zeros((len(x), len(self.rows)))
        for p in range(root.shape[1]):
            np.maximum(low, np.abs(root[:, p, None] - self.to_pivots[None, :, p]), out=low)
        which = low.argmin(axis=1)
        best = squared(x, self.rows[which])
        reach = np.sqrt(best) + ROUNDING
        for c in range(len(self.rows)):
            alive = np.flatnonzero((low[:, c] <= reach) & (which != c))
            d = squared(x[alive], self.rows[c])
            closer = (d < best[alive]) | ((d == best[alive]) & (c < which[alive]))
            rows = alive[closer]
            which[rows], best[rows] = c, d[closer]
            reach[rows] = np.sqrt(best[rows]) + ROUNDING
        return which, best


def _pivot_rows(pivots: np.ndarray, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims)
            far = np.stack([squared(x, p) for p in pivots], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(pivots), pa.int32()), pa.array(far.ravel()))], ["id", "v", "far"])

    return run


def _near(batches: Iterator[pa.RecordBatch], centroids: Centroids, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            x = matrix(part.column(1), dims)
            yield part, x, *centroids.nearest(x, matrix(part.column(2), centroids.to_pivots.shape[1]))


def _sum_rows(centroids: Centroids, dims: int):
    """One row per centroid and task: how many vectors it has there, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids.rows)
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for _, x, which, _ in _near(batches, centroids, dims):
            n += np.bincount(which, minlength=k)
            for c in np.unique(which):
                sums[c] += x[which == c].sum(axis=0)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(n[has]), pa.array(list(sums[has]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assigned_rows(centroids: Centroids, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, which, best in _near(batches, centroids, dims):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(which.astype(np.int32)), pa.array(best)], ["id", "cluster", "distance"])

    return run


def integer_vectors(x: Column, dims: int, scale: int, largest: int) -> tuple[Column, Column]:
    """floor(scale * x) of each component, and whether the vector has ``dims`` components that all are finite and no larger than ``largest`` then."""
    fits = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) <= largest))
    return F.transform(x, lambda c: F.floor(c * scale).cast("int")), F.coalesce(fits, F.lit(False))


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """k-means on floor(``scale`` * x): id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector.

    Centroids start as the ``k`` vectors with the smallest sha256 of ``seed:id``; after ``rounds`` rounds vectors are assigned once
    more. Vectors with another number of components, or with null or non-finite ones, are left out, as are components whose integers
    exceed 2**27: no 64-bit distance could hold them. Each row is a vector of its own, also where rows or ids repeat; of equal hashes
    the smaller vector comes first, and null ids start no centroid before all others. With fewer vectors than ``k`` there are as many
    centroids as vectors; an empty table gives no rows. Sums beyond 64 bits are given as the largest one. Other columns are ignored.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    values, fits = integer_vectors(F.col("x"), dims, scale, LARGEST)
    kept = src.where(fits).select("id", values.alias("v"))
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(max(k, PIVOT_POOL)).collect()
    pool = np.array([r.v for r in first], dtype=np.int64).reshape(-1, dims)
    if not len(pool):
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    pivots = choose_pivots(pool, PIVOTS)
    table = materialize(kept.mapInArrow(_pivot_rows(pivots, dims), "id long, v array<int>, far array<long>"), "pivots")
    rows = pool[:k]
    for _ in range(rounds):
        sums = table.mapInArrow(_sum_rows(Centroids(rows, pivots), dims), "cluster int, n long, sums array<long>")
        sums = sums.select("cluster", "n", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        rows = rows.copy()
        for r in sums.collect():
            rows[r.cluster, r.dim] = int(r.s) // r.n
    assigned = materialize(table.mapInArrow(_assigned_rows(Centroids(rows, pivots), dims), "id long, cluster int, distance long"), "assigned")
    release(table)
    parts = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    told = [(c, min(s, BIG), min(sum(parts.values()), BIG), digest(rows[c])) for c, s in parts.items()]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # A row per centroid.
    out = assigned.join(F.broadcast(told), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
