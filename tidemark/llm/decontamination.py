"""Benchmark decontamination with an FM-index per training shard.

A shard is a few megabytes of whole texts. Its words become symbols: one per word of the test phrases, and a separator for all
others. A phrase cannot cross a separator, so stretches between separators that are shorter than the shortest phrase need no
index; the others are cut into overlapping strings of bounded length, so that the suffix sort needs a bounded number of
doubling rounds. Phrases are searched backwards, all at once, with ranks from a wavelet matrix over the Burrows-Wheeler transform;
occurrences are located from sampled suffix positions and merged into removal spans per text.

Test phrases travel to the tasks in blocks of at most ``BLOCK_WORDS`` words; each block is one more pass over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytetext import ALNUM, Slice, hash_words, slices, split_words
from tidemark.llm.storage import materialize

SHARD_BYTES = 2 << 20
BLOCK_WORDS = 1_000_000
STRING_WORDS = 64
SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of a text of strings that each end with a 0; the zeros count as different, in order of position."""
    n = len(text)
    zero = text == 0
    key = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + n)
    order = np.argsort(key, kind="stable")
    step = 1
    while True:
        k = key[order]
        new = np.ones(n, dtype=np.int64)
        new[1:] = k[1:] != k[:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
        # Only suffixes that still share a rank are sorted on.
        alone = new.astype(bool) & np.append(new[1:].astype(bool), True)
        if alone.all():
            return order
        at = np.flatnonzero(~alone)
        tied = order[at]
        key = rank * (n + 1)
        key[tied] += rank[np.minimum(tied + step, n - 1)]
        order[at] = tied[np.argsort(key[tied], kind="stable")]
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane per binary digit."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.zeros: list[np.ndarray] = []
        x = symbols
        for b in range(self.bits - 1, -1, -1):
            bit = (x >> b) & 1
            ranks = np.zeros(len(x) + 1, dtype=np.int32)
            np.cumsum(1 - bit, out=ranks[1:])
            self.zeros.append(ranks)
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        self.first = np.zeros(largest + 2, dtype=np.int64)
        np.cumsum(np.bincount(symbols, minlength=largest + 1), out=self.first[1:])
        # Where the block of each symbol begins below the last plane.
        self.lead = np.zeros(largest + 1, dtype=np.int64)
        self.lead = self.rank(np.arange(largest + 1), np.zeros(largest + 1, dtype=np.int64))

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol c stands before position at."""
        for level, ranks in enumerate(self.zeros):
            z = ranks[at]
            at = np.where((c >> (self.bits - 1 - level)) & 1 == 0, z, ranks[-1] + at - z)
        return at - self.lead[c]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at a position and its rank there."""
        c = np.zeros(len(at), dtype=np.int64)
        for ranks in self.zeros:
            z = ranks[at]
            one = ranks[at + 1] == z
            c = 2 * c + one
            at = np.where(one, ranks[-1] + at - z, z)
        return c, at - self.lead[c]


class FMIndex:
    def __init__(self, text: np.ndarray, largest: int):
        order = suffix_array(text)
        self.n = len(text)
        before = text[order - 1].astype(np.int64)
        self.wavelet = WaveletMatrix(before, largest)
        self.first = self.wavelet.first
        # The zeros are not in the order that stepping back over them would need, so each string's first suffix is sampled too.
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled, self.sample_rank, self.samples = sampled, np.cumsum(sampled) - 1, order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (rows of symbols, one length) that occur: their row and the rows [lo, hi) of the index."""
        row = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[row, j]
            lo, hi = self.first[c] + self.wavelet.rank(c, lo), self.first[c] + self.wavelet.rank(c, hi)
            on = lo < hi
            row, lo, hi = row[on], lo[on], hi[on]
        return row, lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of index rows: step back until a sampled one."""
        out = np.empty(len(at), dtype=np.int64)
        todo, steps = np.arange(len(at)), 0
        while len(todo):
            done = self.sampled[at]
            out[todo[done]] = self.samples[self.sample_rank[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            c, r = self.wavelet.access(at)
            at = self.first[c] + r
            steps += 1
        return out


class Phrases:
    """Distinct windows of one block of test items, by length, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        words = [(item, split_words(text, ALNUM, True)) for item, text in items]
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, w in words:
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                owners.setdefault(tuple(w[i : i + n]), set()).add(item)
        vocabulary = sorted({w for p in owners for w in p})
        h = hash_words(vocabulary)
        order = np.argsort(h)
        self.hash = h[order]
        number = {vocabulary[i]: k + 1 for k, i in enumerate(order.tolist())}
        self.largest = len(vocabulary)
        self.shortest = min((len(p) for p in owners), default=0)
        self.longest = max((len(p) for p in owners), default=0)
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = []
        self.items: list[list[str]] = []
        for n in sorted({len(p) for p in owners}):
            group = sorted(p for p in owners if len(p) == n)
            self.by_length.append((np.array([[number[w] for w in p] for p in group], dtype=np.int64), np.arange(len(group)) + len(self.items)))
            self.items += [sorted(owners[p]) for p in group]

    def occurrences(self, part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window number, first word and number of words of each occurrence in a shard."""
        none = np.zeros(0, dtype=np.int64)
        if not self.largest or not len(part.start):
            return none, none, none
        h = part.hashes()
        at = np.minimum(np.searchsorted(self.hash, h), self.largest - 1)
        symbol = np.where(self.hash[at] == h, at + 1, 0)
        # Stretches of known words within a text.
        known = symbol > 0
        edge = np.ones(len(h) + 1, dtype=bool)
        edge[1:-1] = (known[1:] != known[:-1])
        edge[part.first] = True
        begin = np.flatnonzero(edge[:-1])
        end = np.append(begin[1:], len(h))
        long = known[begin] & (end - begin >= self.shortest)
        begin, end = begin[long], end[long]
        if not len(begin):
            return none, none, none
        # Strings start every STRING_WORDS words and reach over the next start by the longest window less one.
        pieces = -(-(end - begin) // STRING_WORDS)
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(begin, pieces) + piece * STRING_WORDS
        size = np.minimum(STRING_WORDS + self.longest - 1, np.repeat(end, pieces) - start)
        n = size + 1
        cut = np.cumsum(n) - n
        inner = np.arange(n.sum()) - np.repeat(cut, n)
        where = np.repeat(start, n) + inner
        text = np.where(inner == np.repeat(size, n), 0, symbol[np.minimum(where, len(symbol) - 1)])
        index = FMIndex(text, self.largest)
        out = []
        for phrases, number in self.by_length:
            row, lo, hi = index.search(phrases)
            count = hi - lo
            rows = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            out.append((np.repeat(number[row], count), where[index.locate(rows)], np.full(count.sum(), phrases.shape[1])))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _spans(part: Slice, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged spans of words: text, start and end within the text."""
    depth = np.bincount(first, minlength=len(part.start) + 1) - np.bincount(first + size, minlength=len(part.start) + 1)
    hit = np.cumsum(depth)[: len(part.start)] > 0
    on = hit.copy()
    on[1:] &= ~hit[:-1]
    on[part.first[:-1][part.counts() > 0]] |= hit[part.first[:-1][part.counts() > 0]]
    off = hit.copy()
    off[:-1] &= ~hit[1:]
    last = part.first[1:][part.counts() > 0] - 1
    off[last] |= hit[last]
    begin, end = np.flatnonzero(on), np.flatnonzero(off) + 1
    row = np.searchsorted(part.first, begin, "right") - 1
    return row, begin - part.first[row], end - part.first[row]


def _lists(row: np.ndarray, rows: int, values: pa.Array) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


SPAN = pa.struct([pa.field("s", pa.int32()), pa.field("e", pa.int32())])


def scan(text: pa.Array, phrases: Phrases) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, spans and items of each text."""
    counts, spans, items = [], [], []
    for part in slices(text, ALNUM, True, SHARD_BYTES):
        window, first, size = phrases.occurrences(part)
        row, s, e = _spans(part, first, size)
        counts.append(part.counts())
        spans.append(_lists(row, part.rows, pa.StructArray.from_arrays([pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], fields=list(SPAN))))
        row = np.searchsorted(part.first, first, "right") - 1
        met = np.unique(np.column_stack([row, window]), axis=0) if len(row) else np.zeros((0, 2), dtype=np.int64)
        names: list[list[str]] = [[] for _ in range(part.rows)]
        for r, w in met.tolist():
            names[r] += phrases.items[w]
        items.append(pa.array([sorted(set(x)) for x in names], pa.list_(pa.string())))
    if not counts:
        return pa.array([], pa.int64()), pa.array([], pa.list_(SPAN)), pa.array([], pa.list_(pa.string()))
    return pa.array(np.concatenate(counts)), pa.concat_arrays(spans), pa.concat_arrays(items)


def _scan_rows(phrases: Phrases, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, items = scan(batch.column(at), phrases)
            yield pa.RecordBatch.from_arrays([*batch.columns, n, spans, items], [*batch.schema.names, "n", "spans", "items"])

    return run


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[Phrases]:
    """Test items in blocks of about BLOCK_WORDS words; one block is held at a time."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).dropna()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // (BLOCK_WORDS * 6)))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        yield Phrases([(r.item, r.text) for r in rows], window)


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int) -> DataFrame:
    """``docs`` with its columns renamed to c0, c1, ..., and n (words), spans (sorted spans of hit words per block) and items (of the items with
    occurring windows). Blocks of test items beyond the first are looked for one after the other, and their hits, which depend on the text
    alone, are written and joined back by it: no task holds more than one block."""
    own = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = docs.columns.index(text_col)
    schema = lambda df: ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields), "n long, spans array<struct<s:int,e:int>>, items array<string>"])
    key = [F.xxhash64(f"c{at}").alias("h1"), F.xxhash64(F.lit(1), f"c{at}").alias("h2")]
    out, more = None, []
    for phrases in blocks_of(benchmark, item_col, item_text_col, window):
        if out is None:
            out = own.mapInArrow(_scan_rows(phrases, at), schema(own))
        else:
            texts = own.select(f"c{at}")
            hits = texts.mapInArrow(_scan_rows(phrases, 0), schema(texts)).where(F.size("spans") > 0)
            more.append(materialize(hits.select(*key, "spans", "items").dropDuplicates(["h1", "h2"]), "hits"))
    if not more:
        return out
    rest = reduce(DataFrame.unionByName, more).groupBy("h1", "h2").agg(F.flatten(F.collect_list("spans")).alias("spans2"), F.flatten(F.collect_list("items")).alias("items2"))
    both = out.select("*", *key).join(rest, ["h1", "h2"], "left")
    joined = lambda a, b: F.concat(a, F.when(F.col(b).isNotNull(), F.col(b)).otherwise(F.filter(F.col(a), lambda x: F.lit(False)))).alias(a)
    return both.select(*own.columns, "n", joined("spans", "spans2"), joined("items", "items2"))


def hit_words(spans: str) -> F.Column:
    """Words covered by spans that may overlap."""
    return F.expr(f"aggregate(array_sort({spans}), named_struct('n', 0L, 'to', 0), (a, x) -> named_struct('n', a.n + greatest(0, x.e - greatest(x.s, a.to)), 'to', greatest(a.to, x.e)), a -> a.n)")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """Hit words of each document: id, n_words, n_hit, n_items, items_sha256, contaminated, and spans (start, end in words; sorted, of
    different blocks of test items possibly overlapping). A window is ``window`` consecutive words of a test item, or all words of a shorter item.

    One row per input row, repeated rows included. Null and empty texts have no words; null and empty test items have no windows,
    and test items with a null id are left out. Without test items nothing is hit. Other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = annotate(src, benchmark, "text", item_col, item_text_col, window).withColumn("items", F.array_sort(F.array_distinct("items")))
    return found.select(
        F.col("c0").alias(id_col),
        F.col("n").alias("n_words"),
        hit_words("spans").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.array_sort("spans").alias("spans"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of a test item occurs, with their columns, whatever these are called. Null and empty texts stay;
    repeated rows stay or go together; an empty table stays empty; without test items all rows stay."""
    found = annotate(docs, benchmark, text_col, item_col, item_text_col, window).where(F.size("spans") == 0)
    return found.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)
