"""The shared split of labelled rows and the bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNIT = 1 << 20


def held_out(id_col: str | Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5. Rows without an id are held out too: nothing is learned from them."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(id, text, label) of about ``most`` labelled rows outside the held-out fold, chosen by a hash of the id.

    The choice is applied to both sides before they are joined, so only the texts in the sample are shuffled. Ids with several
    labels take the largest one; null ids, labels and texts teach nothing.
    """
    have = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")).where(~held_out("id")).dropna()
    have = have.groupBy("id").agg(F.max("label").alias("label"))
    n = have.count()
    share = _UNIT if n <= most else max(1, _UNIT * most // n)
    picked = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(_UNIT)) < share
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(~held_out("id")).dropna()
    return src.where(picked).join(have.where(picked), "id")


def sigmoid(x):
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
