"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into halves; each half has its own codebook (k-means on a bounded sample), and pairs of codewords form the
cells of a product grid. Every vector is listed in its nearest cell. For its neighbours a vector visits cells in the order of the
sum of both half distances (multi-sequence traversal) until the sum exceeds the smallest one by a margin. The margin is the
quantile at the target recall of what the near pairs of sampled vectors need. Listed and visiting vectors of a cell meet in blocks of bounded
size, where cosines are verified in double precision; a block gives link counts and a spanning forest, not pairs.

Equal vectors are one vector with a weight.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.storage import materialize

SAMPLE_ROWS = 20_000
QUERIES = 2_000
SAFETY = 3.0
PER_CELL = 128
#: Sampled vectors that each codeword has at least. More vectors than SAMPLE_ROWS / PER_CODEWORD codewords a half can serve at PER_CELL
#: (three billion) ask for a larger sample.
PER_CODEWORD = 4
BLOCK = 2048
TARGET_RECALL = 0.999


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([distances(x[at : at + 1024], c).argmin(axis=1) for at in range(0, len(x), 1024)])
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :], 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that the squares of huge or tiny ones stay finite and above zero."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-320)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Index:
    def __init__(self, left: np.ndarray, right: np.ndarray, margin: float):
        self.left, self.right, self.margin = left, right, margin

    def half_distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = x.shape[1] // 2
        return distances(x[:, :h], self.left), distances(x[:, h:], self.right)

    def cell(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        return d1.argmin(axis=1) * len(self.right) + d2.argmin(axis=1)

    def excess(self, d1: np.ndarray, d2: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How much farther than its nearest cell each vector is from the given one."""
        i, j = np.divmod(cell, len(self.right))
        row = np.arange(len(d1))
        return d1[row, i] + d2[row, j] - d1.min(axis=1) - d2.min(axis=1)

    def visits(self, d1: np.ndarray, d2: np.ndarray) -> list[list[int]]:
        """Cells of each vector by multi-sequence traversal: nearest first, until the margin is passed."""
        out = []
        o1, o2 = d1.argsort(axis=1, kind="stable"), d2.argsort(axis=1, kind="stable")
        for a, b, p, q in zip(np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1), o1, o2, strict=True):
            limit, cells = a[0] + b[0] + self.margin, []
            heap, pushed = [(a[0] + b[0], 0, 0)], {(0, 0)}
            while heap:
                d, i, j = heapq.heappop(heap)
                if d > limit:
                    break
                cells.append(int(p[i]) * len(self.right) + int(q[j]))
                for s, t in ((i + 1, j), (i, j + 1)):
                    if s < len(a) and t < len(b) and (s, t) not in pushed:
                        pushed.add((s, t))
                        heapq.heappush(heap, (a[s] + b[t], s, t))
            out.append(cells)
        return out


def pair_margin(index: Index, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The margin by which each pair (rows of u and v) meets from at least one side."""
    du, dv = index.half_distances(u), index.half_distances(v)
    return np.minimum(index.excess(*du, index.cell(*dv)), index.excess(*dv, index.cell(*du)))


def made_margin(index: Index, x: np.ndarray, threshold: float, recall: float, seed: int = 17) -> float:
    """The margin for made neighbours of sampled vectors, with cosines between the threshold and 1."""
    rng = np.random.default_rng(seed)
    noise = rng.normal(size=x.shape)
    noise = unit(noise - (noise * x).sum(axis=1, keepdims=True) * x + 1e-12)
    cos = rng.uniform(threshold, 1.0, len(x))[:, None]
    return float(np.quantile(pair_margin(index, x, cos * x + np.sqrt(1 - cos * cos) * noise), recall))


def _margin_rows(index: Index, queries: np.ndarray, threshold: float):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                x = unit(matrix(batch.column(0).slice(at, 2048)))
                s = queries @ x.T
                a, b = np.nonzero((s >= threshold) & (s < 1 - 1e-12))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(pair_margin(index, queries[a], x[b]))], ["q", "m"])

    return run


def fit_index(reps: DataFrame, rows: int, threshold: float, recall: float = TARGET_RECALL) -> Index:
    """Codebooks from about SAMPLE_ROWS vectors, as large as ``rows`` vectors at PER_CELL a cell ask for. The margin is the ``recall``
    quantile of what QUERIES sampled vectors need for their farthest true neighbour, found by brute force over all rows, times SAFETY;
    with fewer than 50 vectors that have neighbours it is that of made neighbours."""
    share = max(1, int(min(1.0, SAMPLE_ROWS / rows) * (1 << 20)))
    picked = reps.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < share).orderBy("id")
    x = matrix(picked.select("x").toArrow()["x"])
    if not len(x):
        x = matrix(reps.orderBy("id").limit(1000).select("x").toArrow()["x"])
    x = unit(x)
    k = int(np.clip(np.ceil(np.sqrt(rows / PER_CELL)), 1, max(1, len(x) // PER_CODEWORD)))
    h = x.shape[1] // 2
    index = Index(kmeans(x[:, :h], k), kmeans(x[:, h:], k, seed=4), 0.0)
    queries = x[np.random.default_rng(9).permutation(len(x))[:QUERIES]]
    margins = reps.select("x").mapInArrow(_margin_rows(index, queries, threshold), "q long, m double").groupBy("q").agg(F.max("m").alias("m"))
    got = margins.agg(F.count("m").alias("n"), F.percentile_approx("m", recall, 10_000).alias("m")).first()
    index.margin = SAFETY * got.m + 1e-9 if got.n >= 50 else made_margin(index, queries, threshold, recall)
    return index


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _listing(index: Index):
    """Each vector listed in its own cell (role 0) and visiting cells (role 1)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                d = index.half_distances(unit(matrix(part.column(1))))
                home, visits = index.cell(*d), index.visits(*d)
                rows = np.repeat(np.arange(len(home)), [1 + len(v) for v in visits])
                cells = [c for h, v in zip(home.tolist(), visits, strict=True) for c in (h, *v)]
                role = [r for v in visits for r in (0, *([1] * len(v)))]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(role, pa.int32()), *(part.column(i).take(take) for i in range(3))], ["cell", "role", "id", "x", "weight"])

    return run


def meet(index: Index, threshold: float):
    """Verify one block: link weight and root of each linked vector."""

    def run(table: pa.Table) -> pa.Table:
        role = table["role"].to_numpy()
        ids, weight, x = table["id"].to_numpy(), table["weight"].to_numpy(), unit(matrix(table["x"]))
        m, v = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        linked = (x[m] @ x[v].T >= threshold) & (ids[m][:, None] != ids[v][None, :])
        # A pair that both sides find counts where the visitor has the larger id.
        i, j = np.nonzero(linked)
        d = index.half_distances(x[m])
        home = index.cell(*index.half_distances(x[v])) if len(v) else np.zeros(0, dtype=np.int64)
        a, b = np.divmod(home, len(index.right))
        back = d[0][i, a[j]] + d[1][i, b[j]] - d[0].min(axis=1)[i] - d[1].min(axis=1)[i] <= index.margin + 1e-9
        count = ~back | (ids[v[j]] > ids[m[i]])
        n = np.bincount(m[i[count]], weight[v[j[count]]], len(ids)) + np.bincount(v[j[count]], weight[m[i[count]]], len(ids))
        root = np.where(np.bincount(np.concatenate([m[i], v[j]]), minlength=len(ids)) > 0, ids, np.iinfo(np.int64).max)
        while len(i):  # smallest id around, until nothing moves
            new = root.copy()
            big = np.iinfo(np.int64).max
            if len(m) and len(v):
                new[m] = np.minimum(root[m], np.where(linked, root[v][None, :], big).min(axis=1))
                new[v] = np.minimum(root[v], np.where(linked, new[m][:, None], big).min(axis=0))
            if (new == root).all():
                break
            root = new
        on = np.flatnonzero(root != np.iinfo(np.int64).max)
        return pa.table({"id": ids[on], "n": n[on].astype(np.int64), "root": root[on]})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """n_links, component_id and kept of each vector, by cosine >= ``threshold``.

    One row per input row. Links are found by the index (target recall TARGET_RECALL, codebooks fit on SAMPLE_ROWS sampled vectors;
    all rows are listed and visit) and verified, so none below the threshold is reported. Vectors that are null, zero, of another
    dimension than most, or hold null or non-finite components link with nothing. A null id links with nothing and is not kept.
    Rows that repeat an id count as one vector per distinct content. Other columns are ignored.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    limit = F.lit(1.7976931348623157e308)
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= limit)) & F.exists("x", lambda c: c != 0)
    good = src.where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(finite)
    size = good.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    good = good.where(F.size("x") == (size[0].n if size else 0))
    key = [F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2")]
    members = materialize(good.select("id", *key).distinct(), "members")
    groups = members.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    reps = good.select(F.col("id").alias("rep"), "x", *key).dropDuplicates(["rep", "h1", "h2"]).join(groups, ["rep", "h1", "h2"])
    reps = materialize(reps.select(F.col("rep").alias("id"), "x", "weight"), "vectors")
    rows = reps.count()
    if rows:
        index = fit_index(reps, rows, threshold)
        listing = reps.mapInArrow(_listing(index), "cell int, role int, id long, x array<double>, weight long")
        listing = materialize(listing.withColumn("x", F.col("x").cast("array<float>")) if _is_float(vectors, vector_col) else listing, "listing")
        sizes = listing.groupBy("cell").agg(F.ceil(F.sum(1 - F.col("role")) / BLOCK).alias("mb"), F.ceil(F.sum("role") / BLOCK).alias("vb")).where("mb > 0 and vb > 0")
        placed = listing.join(sizes, "cell")
        own = F.when(F.col("role") == 0, F.pmod(F.xxhash64("id"), "mb")).otherwise(F.pmod(F.xxhash64("id"), "vb"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("role") == 0, F.col("vb")).otherwise(F.col("mb")) - 1))
        placed = placed.withColumn("own", own).withColumn("other", other)
        placed = placed.select("cell", F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("other")).alias("b"), F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("own")).alias("v"), "role", "id", "x", "weight")
        met = materialize(placed.groupBy("cell", "b", "v").applyInArrow(meet(index, threshold), "id long, n long, root long"), "met")
    else:
        met = vectors.sparkSession.createDataFrame([], "id long, n long, root long")
    links = met.groupBy("id").agg(F.sum("n").alias("n"))
    groups = groups.join(links, groups["rep"] == links["id"], "left").drop("id")
    joined = members.join(groups, ["h1", "h2"])
    # Equal vectors are linked to each other, others by way of their representatives.
    edges = met.select("id", "root").unionByName(joined.select("id", F.col("rep").alias("root")))
    parts = components(edges, "id", "root")
    per_id = joined.groupBy("id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = src.select("id").join(per_id, "id", "left").join(parts, F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _is_float(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.simpleString() == "array<float>"
