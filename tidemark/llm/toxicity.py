"""Toxicity from a lexicon that tolerates misspellings.

The lexicon is learned: words, and stems that begin words, which nearly only labelled-toxic training texts hold. Its trie is
intersected with Levenshtein automata (one edit for words of ``FUZZY_LENGTH`` letters or more) into one deterministic table,
which runs over the bytes of all words of a batch at once. Each hit is looked at in its context window: between quotation marks
it speaks less, next to a word of address more. A logistic regression over the counts gives the score.
"""

from __future__ import annotations

from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytetext import ALNUM, Rolling, Slice, hash_words, mix, signed, slices, split_words
from tidemark.llm.folds import held_out, sigmoid, training_rows
from tidemark.llm.storage import materialize, release

FUZZY_LENGTH = 6
STEM_LENGTHS = range(4, 8)
STEM_WORDS = 3
WINDOW_BYTES = 80
#: Quotation marks in UTF-8 (the last byte of typographic ones is enough beside the first) and words of address.
QUOTES = b'"'
ADDRESS = "you your youre u are du dich ihr sie tu te vous toi eres usted"
NONE, EXACT, FUZZY, STEM = range(4)


def terms_of(text: bytes | str) -> set[bytes]:
    """Words of a text and, with a trailing *, the prefixes that could be stems."""
    words = set(split_words(text, ALNUM, True))
    return words | {w[:n] + b"*" for w in words for n in STEM_LENGTHS if len(w) >= n}


def choose_terms(counts: dict[bytes, tuple[int, int]], support: int, precision: float) -> list[bytes]:
    """Terms met in at least ``support`` toxic texts and seldom elsewhere: words, also those that a stem begins, as only words allow an
    edit, and stems of at least ``STEM_WORDS`` of these words. A stem that a kept shorter one covers is left out."""
    good = {t for t, (toxic, clean) in counts.items() if toxic >= support and toxic >= precision * (toxic + clean)}
    kept = [t for t in good if not t.endswith(b"*")]
    begins = Counter(w[:n] + b"*" for w in kept for n in STEM_LENGTHS if len(w) >= n)
    stems: set[bytes] = set()
    for t in sorted((t for t in good if t.endswith(b"*") and begins[t] >= STEM_WORDS), key=len):
        if not any(t[:n] + b"*" in stems for n in STEM_LENGTHS if n < len(t) - 1):
            stems.add(t)
    kept += stems
    return sorted(kept, key=lambda t: (-counts[t][0], t))


class Automaton:
    """Levenshtein automata on a lexicon trie as one table: ``step[state, letter class]`` and ``kind[state]``. State 0 rejects."""

    def __init__(self, terms: list[bytes]):
        children: list[dict[int, int]] = [{}]
        word_at: dict[int, bool] = {}
        stem_at: set[int] = set()
        fuzzy = set([t for t in terms if not t.endswith(b"*") and len(t) >= FUZZY_LENGTH])
        leads: list[bool] = [bool(fuzzy)]  # whether a word that allows an edit lies below
        for t in terms:
            node = 0
            for b in t.rstrip(b"*"):
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    leads.append(False)
                node = children[node][b]
                leads[node] |= t in fuzzy
            if t.endswith(b"*"):
                stem_at.add(node)
            else:
                word_at[node] = t in fuzzy
        letters = sorted({b for c in children for b in c})
        self.letter = np.zeros(256, dtype=np.int32)
        for i, b in enumerate(letters):
            self.letter[b] = i + 1

        def closed(states: set[tuple[int, int]]) -> frozenset:
            out = set(states)
            for node, e in states:  # a letter of the term is missing in the text
                if e == 0:
                    out |= {(c, 1) for c in children[node].values() if leads[c]}
            return frozenset(out)

        def advance(states: frozenset, b: int | None) -> frozenset:
            out: set[tuple[int, int]] = set()
            for node, e in states:
                if b in children[node]:
                    c = children[node][b]
                    if e == 0 or leads[c]:
                        out.add((c, e))
                if e == 0:
                    if leads[node]:
                        out.add((node, 1))  # a letter too many
                    out |= {(c, 1) for x, c in children[node].items() if x != b and leads[c]}  # another letter
            return closed(out)

        def kind_of(states: frozenset) -> int:
            if any(e == 0 and node in word_at for node, e in states):
                return EXACT
            return FUZZY if any(e == 1 and word_at.get(node) for node, e in states) else NONE

        stem_state = 1
        start = closed({(0, 0)})
        number: dict[frozenset, int] = {start: 2}
        rows, kinds, todo = {0: [0] * (len(letters) + 1), stem_state: [stem_state] * (len(letters) + 1)}, {0: NONE, stem_state: STEM, 2: NONE}, deque([start])
        while todo:
            states = todo.popleft()
            row = []
            for b in [None, *letters]:
                to = advance(states, b)
                if any(e == 0 and node in stem_at for node, e in to):
                    row.append(stem_state)
                elif not to:
                    row.append(0)
                else:
                    if to not in number:
                        number[to] = len(number) + 2
                        kinds[number[to]] = kind_of(to)
                        todo.append(to)
                    row.append(number[to])
            rows[number[states]] = row
        n = len(number) + 2
        self.step = np.array([rows[i] for i in range(n)], dtype=np.int32)
        self.kind = np.array([kinds[i] for i in range(n)], dtype=np.int8)

    def run(self, part: Slice) -> np.ndarray:
        """The kind of hit of each word."""
        state = np.full(len(part.start), 2, dtype=np.int32)
        size = part.end - part.start
        alive, at = np.arange(len(size)), 0
        while len(alive):
            state[alive] = self.step[state[alive], self.letter[part.data[part.start[alive] + at]]]
            at += 1
            alive = alive[(state[alive] > 1) & (size[alive] > at)]
        return self.kind[state]


def features(part: Slice, automaton: Automaton, address: np.ndarray) -> np.ndarray:
    """Counts per text: exact, fuzzy and stem hits, hits in quotation, hits with address near, words."""
    kind = automaton.run(part)
    hit = np.flatnonzero(kind)
    row = np.searchsorted(part.first, hit, "right") - 1
    marks = np.zeros(len(part.data) + 1, dtype=np.int64)
    typographic = (part.data[:-1] == 0xC2) & ((part.data[1:] == 0xAB) | (part.data[1:] == 0xBB)) if len(part.data) > 1 else np.zeros(0, dtype=bool)
    is_quote = np.isin(part.data, np.frombuffer(QUOTES, dtype=np.uint8))
    if len(part.data) > 2:
        is_quote[:-1] |= typographic
        is_quote[:-2] |= (part.data[:-2] == 0xE2) & (part.data[1:-1] == 0x80) & np.isin(part.data[2:], [0x9C, 0x9D, 0x9E])
    np.cumsum(is_quote, out=marks[1:])
    begin, end = part.start[hit], part.end[hit]
    before = marks[begin] - marks[np.maximum(begin - WINDOW_BYTES, part.offsets[row])]
    after = marks[np.minimum(end + WINDOW_BYTES, part.offsets[row + 1])] - marks[end]
    quoted = (before % 2 == 1) & (after > 0)
    near = np.zeros(len(hit), dtype=bool)
    if len(hit):
        h = part.hashes()
        for d in (-3, -2, -1, 1, 2, 3):
            i = hit + d
            ok = (i >= part.first[row]) & (i < part.first[row + 1])
            near[ok] |= np.isin(h[i[ok]], address)
    count = lambda mask: np.bincount(row[mask], minlength=part.rows).astype(np.float64)
    k = kind[hit]
    return np.column_stack([count(k == EXACT), count(k == FUZZY), count(k == STEM), count(quoted), count(near), part.counts()])


def design(x: np.ndarray) -> np.ndarray:
    """Counts to regression inputs: presence and strength of each kind outside quotation, quotation, address, density."""
    hits = x[:, :3].sum(axis=1)
    free = np.maximum(hits - x[:, 3], 0)
    return np.column_stack([np.ones(len(x)), np.minimum(x[:, :3], 1), np.log1p(x[:, :3]), np.log1p(x[:, 3]), np.log1p(x[:, 4]), np.minimum(free, 1), np.log1p(1000 * free / np.maximum(x[:, 5], 1))])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method for logistic loss with a ridge (not on the first column)."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, terms: list[bytes], weights: np.ndarray):
        self.automaton, self.weights = Automaton(terms), weights
        self.address = hash_words([w.encode() for w in ADDRESS.split()])

    def scores(self, text: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for part in slices(text, ALNUM, True):
            out.append(sigmoid(design(features(part, self.automaton, self.address)) @ self.weights))
        return np.concatenate(out)


def _signed_rows(batches):
    """Each training text with a signature that copies mostly share, also near ones: its smallest hash of three words."""
    for batch in batches:
        out = np.zeros(batch.num_rows, dtype=np.int64)
        for part in slices(batch.column(0), ALNUM, True):
            h, n = part.hashes(), part.counts()
            at = np.flatnonzero(n > 0)
            if len(at):
                grams = mix(Rolling(mix(h)).of(np.arange(len(h)), np.minimum(np.arange(len(h)) + 3, np.repeat(part.first[1:], n))))
                out[part.row + at] = signed(np.minimum.reduceat(grams, part.first[:-1][at]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["text", "label", "signature"])


def _term_counts(batches):
    """Texts per term and label in each batch."""
    for batch in batches:
        met: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            met[int(y)].update(terms_of(text))
        keys = sorted(met[0].keys() | met[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([met[1][k] for k in keys], pa.int64()), pa.array([met[0][k] for k in keys], pa.int64())], ["term", "toxic", "clean"])


def _feature_rows(terms: list[bytes]):
    def run(batches):
        model = Model(terms, np.zeros(1))
        for batch in batches:
            for part in slices(batch.column(0), ALNUM, True):
                x = features(part, model.automaton, model.address)
                y = batch.column(1).slice(part.row, part.rows).cast(pa.float64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), y], ["a", "b", "c", "d", "e", "f", "y"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 20_000, support: int = 8, precision: float = 0.97) -> Model:
    """Learn lexicon and weights from about ``most_rows`` labelled rows outside the held-out fold. Without any, the lexicon is empty and
    every score is 0.5 or less. Of copies of one text mostly one teaches, so that a copied document's words are not taken for a
    vocabulary. An id with several labels is toxic if one says so; rows that repeat an id teach with each of their texts."""
    rows = training_rows(docs, labels, id_col, text_col, label_col, most_rows).select("text", F.col("label").cast("int").alias("label"))
    rows = rows.mapInArrow(_signed_rows, "text string, label int, signature long").groupBy("label", "signature").agg(F.min("text").alias("text"))
    rows = materialize(rows.select("text", "label"), "training")
    counts = rows.mapInArrow(_term_counts, "term binary, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # As many as the bounded sample supports.
    counts = counts.where((F.col("toxic") >= support) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("clean"))))
    terms = choose_terms({bytes(r.term): (r.toxic, r.clean) for r in counts.collect()}, support, precision)
    got = rows.mapInArrow(_feature_rows(terms), "a double, b double, c double, d double, e double, f double, y double").toPandas().to_numpy(dtype=float)
    release(rows)
    x = design(got[:, :6]) if len(got) else design(np.zeros((1, 6)))
    y = got[:, 6] if len(got) else np.zeros(1)
    return Model(terms, fit_logistic(x, y))


def _score_rows(model: Model):
    def run(batches):
        for batch in batches:
            score = model.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])

    return run


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score in [0, 1] and predicted (score >= 0.5) of each input row, repeated rows included.

    Null and empty texts have no hits and get the score of a text without hits. Null ids stay null and count as held out.
    Other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(_score_rows(model), "id long, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns, whatever these are called. Null and empty texts stay; repeated
    rows stay or go together; an empty table stays empty."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
