"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent.

Subwords are byte 3-grams and 4-grams of the lower-cased text, word boundaries included, hashed to ``BUCKETS`` embeddings. A text
is the mean of its embeddings. For prediction each bucket's share of every language's logit is tabled, so a text costs one
lookup per byte and language. The softmax temperature and the rejection threshold are set on training rows that the descent did
not see.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytetext import LOWER, pieces
from tidemark.llm.folds import held_out, training_rows

BUCKETS = 1 << 15
DIMENSIONS = 16
UNKNOWN = "und"
SIZES = (3, 4)
ASCII_LETTER = np.zeros(256, dtype=bool)
ASCII_LETTER[97:123] = True


def buckets(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte (lower-cased bytes, n up to 4)."""
    if len(data) < n:
        return np.zeros(0, dtype=np.int32)
    x = data[: len(data) - n + 1].astype(np.uint32)
    for k in range(1, n):
        x = (x << np.uint32(8)) | data[k : len(data) - n + 1 + k]
    x = (x ^ np.uint32(n * 0x01000193)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    return ((x * np.uint32(0x85EBCA77)) >> np.uint32(17)).astype(np.int32)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one whole training text and their shares."""
    data = LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    ids, n = np.unique(np.concatenate([buckets(data, k) for k in SIZES]), return_counts=True)
    return ids, n / max(1, n.sum())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """table: each bucket's share of the logits, by language; temperature; threshold below which a prediction is not accepted."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.languages, self.table, self.bias, self.temperature, self.threshold = languages, table.astype(np.float32), bias, temperature, threshold

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean over the n-grams that lie inside each text."""
        data = LOWER[data]
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        grams = np.zeros(len(offsets) - 1)
        for n in SIZES:
            ids = buckets(data, n)
            lo = np.minimum(offsets[:-1], len(ids))
            hi = np.clip(offsets[1:] - n + 1, lo, len(ids))
            grams += hi - lo
            for k in range(len(self.languages)):
                sums = np.zeros(len(ids) + 1)
                np.cumsum(self.table[:, k][ids], dtype=np.float64, out=sums[1:])
                total[:, k] += sums[hi] - sums[lo]
        return (total / np.maximum(grams, 1)[:, None] + self.bias) / self.temperature

    def predict(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language (-1: no letter), its probability and whether it is accepted."""
        best, score = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for data, offsets, row in pieces(text):
            letters = np.concatenate([[0], np.cumsum(ASCII_LETTER[LOWER[data]])])
            none = letters[offsets[1:]] == letters[offsets[:-1]]
            for i in np.flatnonzero(none & (np.diff(offsets) > 0)):
                none[i] = not any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode(errors="replace"))
            if not self.languages:
                none[:] = True
                p = np.zeros((len(none), 1))
            else:
                p = softmax(self.logits(data, offsets))
            k = p.argmax(axis=1)
            best.append(np.where(none, -1, k))
            score.append(np.where(none, 0.0, p[np.arange(len(k)), k]))
        best, score = np.concatenate(best), np.concatenate(score)
        return best, score, (best >= 0) & (score >= self.threshold)


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str], epochs: int = 4, rate: float = 1.0, seed: int = 11) -> Model:
    """Stochastic gradient descent over single texts; a tenth of the rows sets temperature and rejection threshold."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    aside, fit = order[: len(bags) // 10], order[len(bags) // 10 :]
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    w, bias = rng.normal(0, 0.1, (len(languages), DIMENSIONS)), np.zeros(len(languages))
    steps, at = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            ids, share = bags[i]
            lr = rate * (1 - at / steps)
            at += 1
            v = share @ emb[ids]
            g = softmax(w @ v + bias)
            g[y[i]] -= 1
            back = w.T @ g
            w -= lr * np.outer(g, v)
            bias -= 0.1 * lr * g
            # Shares are small: scaled by the number of distinct buckets, a text moves its embeddings as far as its classifier.
            emb[ids] -= lr * np.minimum(share * len(ids), 4.0)[:, None] * back / np.sqrt(len(ids))
    model = Model(languages, emb @ w.T, bias)
    if len(aside):
        z = np.array([bags[i][1] @ model.table[bags[i][0]].astype(float) + bias for i in aside])
        truth = y[aside]
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        p = softmax(z / model.temperature)
        right, top = p.argmax(axis=1) == truth, p.max(axis=1)
        # The smallest threshold whose accepted rows are right in 99 of 100 cases.
        for t in np.unique(np.concatenate([[0.0], top])):
            if right[top >= t].mean() >= 0.99:
                model.threshold = float(t)
                break
    return model


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = 6_000) -> Model:
    """Learn from about ``most_rows`` rows with a language outside the held-out fold; without any, every prediction is ``und``."""
    labels = docs.select(id_col, F.col(lang_col).alias("known"))
    rows = training_rows(docs, labels, id_col, text_col, "known", most_rows).where("trim(label) <> ''")

    def bags_of(batches):
        for batch in batches:
            got = [bag(t) for t in batch.column(0).to_pylist()]
            kept = [(ids.astype(np.int32), share.astype(np.float32)) for ids, share in got]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.list_(pa.int32())), pa.array([s for _, s in kept], pa.list_(pa.float32())), batch.column(1)], ["ids", "share", "label"])

    got = rows.select("text", "label", "id").select("text", "label").mapInArrow(bags_of, "ids array<int>, share array<float>, label string").toArrow()
    if not len(got):
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    label = got["label"].to_pylist()
    languages = sorted(set(label))
    ids, share = got["ids"].combine_chunks(), got["share"].combine_chunks()
    flat, cut, weight = ids.values.to_numpy(), ids.offsets.to_numpy(), share.values.to_numpy().astype(float)
    bags = [(flat[a:b], weight[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    # Arrival order is not fixed; the seed is, so the texts are put in an order of their own.
    order = sorted(range(len(bags)), key=lambda i: (label[i], len(bags[i][0]), bags[i][0][:8].tolist(), bags[i][1][:8].tolist()))
    return train([bags[i] for i in order], np.array([languages.index(label[i]) for i in order]), languages)


def _predict_rows(model: Model):
    def run(batches):
        names = [*model.languages, UNKNOWN]
        for batch in batches:
            best, score, accepted = model.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.take(pa.array(names), pa.array(np.where(best < 0, len(names) - 1, best))), pa.array(score), pa.array(accepted)], ["id", "lang_pred", "score", "accepted"])

    return run


def identify_language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score (its probability) and accepted (the calibrated rejection says no below the threshold) of each
    input row, repeated rows included. Null texts and texts without any letter are ``und`` with score 0, not accepted. Null ids stay null and
    count as held out. Other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(_predict_rows(model), "id long, lang_pred string, score double, accepted boolean")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score", "accepted")
