import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.folds import sigmoid


def test_every_labelled_row_teaches(spark):
    docs = spark.range(0, 30_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rows = quality.labelled(docs, labels, "doc_id", "text", "quality")
    assert rows.count() == docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).count() > 20_000


def test_fit_over_all_pairs_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 3)) + y[:, None] * [1.0, 0.5, 0.0]
    rows = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y int").repartition(4)
    model = quality.fit_pairs(rows)
    z, w = model.inputs(x), model.weights
    d = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, 6)
    pull = 60_000 / len(d) * d.T @ sigmoid(-(d @ w)) - w
    # The largest entry of the gradient where nothing is learned yet is some thousands.
    assert np.abs(pull).max() < 5
    s = np.sort(z @ w)
    k = int((y == 0).sum())
    assert abs(model.threshold - (s[k - 1] + s[k]) / 2) < 1e-9
    raw = z @ w
    assert abs(model.slope - 4 / (np.median(raw[y == 1]) - np.median(raw[y == 0]))) < 1e-6
