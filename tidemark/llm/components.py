"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize, release

MOST_ROUNDS = 60


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (smallest node reachable) of each node of an edge with two different ends; null ends are left out.

    Each round replaces a node's edges by edges to its smallest neighbour. Minima come from pre-aggregated groups and are joined
    back, so no node's neighbours are gathered in one task.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a).isNotNull()) & (F.col(b).isNotNull()) & (F.col("u") != F.col("v"))).distinct()
    e = materialize(e, "edges")
    seen = None
    for _ in range(MOST_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Larger neighbours go to the smallest node around.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # A node and its smaller neighbours go to the smallest of them.
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        before, e = e, materialize(small.select("x.*").where("u <> v").distinct(), "edges")
        release(before)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
    star = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())
