"""Exact substring dedup by recompression.

Every text is parsed by rounds of recompression: runs of one token, then pairs whose left symbol falls in one half of the
alphabet and whose right symbol falls in the other, become one new symbol. The halves are drawn per round from the symbol's
name, and a name is a hash of the parts, so all tasks give the same name to the same content without exchanging a dictionary.
With each symbol goes the word range that its making depended on: wherever these words stand again, the same symbol stands.

A window of ``window`` words is represented by its longest interior symbol (ties: smallest name, then leftmost), the anchor;
windows next to each other mostly share one. The words of all windows of one anchor occurrence form its block. One row
(anchor, block hash) per occurrence replaces a row per window. Spark groups these rows:

* a block met in several documents: all but the smallest document lose all of the block's windows;
* an anchor met with several blocks (the edges of copies): one representative per distinct block, its smallest document, lists
  its windows one by one, and these are grouped in turn.

A window without a determined interior symbol (long runs) is its own anchor, so no window is left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytetext import NOT_SPACE, U64, Rolling, Slice, mix, signed, slices
from tidemark.llm.storage import distinct_texts, materialize, release

ROUNDS = 7
LONGEST_SYMBOL = 24
LONGEST_RUN = 16


def parse(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS, cap: int = LONGEST_SYMBOL) -> tuple[np.ndarray, ...]:
    """Recompression of words with hashes ``h`` in texts that begin at ``first``: name, start, length and dependency [lo, hi) of each symbol."""
    n = len(h)
    text_lo, text_hi = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    lo = np.arange(n)
    hi = lo + 1
    # Runs of one token. All but the shortest name the whole run; what stands in a longer run stays single.
    new = np.ones(n, dtype=bool)
    if n > 1:
        new[1:] = (h[1:] != h[:-1]) | (text_lo[1:] != text_lo[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, n))
    run_start, run_size = np.repeat(at, size), np.repeat(size, size)
    long = run_size > LONGEST_RUN
    keep = new | long
    name = mix(h)
    named = new & (run_size > 1) & ~long
    name[named] = mix(h[named] + mix(run_size[named].astype(U64)))
    run_end = run_start + run_size
    lo = np.where(long, np.maximum(run_start, lo - LONGEST_RUN), run_start - 1)
    hi = np.where(long, np.minimum(run_end, hi + LONGEST_RUN), run_end + 1)
    size = np.where(named, run_size, 1)
    start, name, lo, hi, size = np.flatnonzero(keep), name[keep], lo[keep], hi[keep], size[keep]
    lo, hi = np.maximum(lo, text_lo[start] - 1), np.minimum(hi, text_hi[start] + 1)
    # A range that reaches beyond its text depends on what no other text shares.
    for r in range(rounds):
        m = len(name)
        if m < 2:
            break
        right = (mix(name ^ U64(0xA0761D6478BD642F + r)) >> U64(63)).astype(bool)
        same = np.ones(m + 1, dtype=bool)  # same[i]: i - 1 and i are in one text
        same[0] = same[m] = False
        same[1:m] = text_lo[start[1:]] == text_lo[start[:-1]]
        pair = np.zeros(m + 1, dtype=bool)  # pair[i]: i - 1 and i become one
        pair[1:m] = same[1:m] & ~right[:-1] & right[1:] & (size[:-1] + size[1:] <= cap)
        head, tail = pair[1:], pair[:-1]
        before, after = np.append(lo[:1], lo[:-1]), np.append(hi[1:], hi[-1:])
        new_lo = np.where(right & ~tail, np.where(same[:-1], np.minimum(lo, before), text_lo[start] - 1), lo)
        new_hi = np.where(~right & ~head, np.where(same[1:], np.maximum(hi, after), text_hi[start] + 1), hi)
        i = np.flatnonzero(head)
        name = name.copy()
        name[i] = mix(name[i] * U64(0xE7037ED1A0B428DB) + mix(name[i + 1] + U64(r + 1)))
        size = size.copy()
        size[i] += size[i + 1]
        new_hi[i] = new_hi[i + 1]
        stay = ~tail
        name, start, size, lo, hi = name[stay], start[stay], size[stay], new_lo[stay], new_hi[stay]
    return name, start, size, lo, hi


def blocks(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Anchor, block hash, first window start and number of windows of each block, by word position."""
    empty = np.zeros(0, dtype=np.int64)
    n = len(h)
    counts = np.diff(first)
    text_end = np.repeat(first[1:], counts)
    s = np.flatnonzero(np.arange(n) + window <= text_end)
    if not len(s):
        return empty.view(U64), empty.view(U64), empty, empty
    name, start, size, lo, hi = parse(h, first)
    m = len(name)
    # Symbols i0..i1-1 depend on words of the window only; both bounds grow with the symbol.
    i0 = np.cumsum(np.bincount(lo + 1, minlength=n + 2))[s]
    i1 = np.cumsum(np.bincount(np.minimum(hi, n + 1), minlength=n + 2))[s + window]
    key = ((U64(63) - np.minimum(size, 63).astype(U64)) << U64(58)) | (name >> U64(6))
    level = [np.arange(m)]
    widest = int((i1 - i0).max(initial=0))
    while (1 << len(level)) <= widest:
        a, step = level[-1], 1 << (len(level) - 1)
        b = np.append(a[step:], np.full(min(step, m), m - 1))[:m]
        level.append(np.where(key[b] < key[a], b, a))
    # Only where a bound moves can the anchor change.
    moved = np.ones(len(s), dtype=bool)
    moved[1:] = (i0[1:] != i0[:-1]) | (i1[1:] != i1[:-1]) | (s[1:] != s[:-1] + 1)
    at = np.flatnonzero(moved)
    a0, a1 = i0[at], i1[at]
    width = a1 - a0
    anchor = np.full(len(at), -1)
    for k, a in enumerate(level):
        j = np.flatnonzero((width >= 1 << k) & (width < 2 << k))
        x, y = a[a0[j]], a[a1[j] - (1 << k)]
        anchor[j] = np.where(key[y] < key[x], y, x)
    anchor = np.repeat(anchor, np.diff(np.append(at, len(s))))
    cut = np.ones(len(s), dtype=bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1) | (anchor[1:] < 0)
    at = np.flatnonzero(cut)
    s0, count, anchor = s[at], np.diff(np.append(at, len(s))), anchor[at]
    whole = Rolling(mix(h ^ U64(0x51ED270B))).of(s0, s0 + count - 1 + window)
    bare = anchor < 0
    offset = np.where(bare, 0, start[anchor] - s0).astype(U64)
    a = np.where(bare, Rolling(mix(h ^ U64(0xC2B2AE35))).of(s0, s0 + window), name[anchor])
    return a, mix(whole + offset * U64(0x9FB21C651E98DF25)), s0, count


def window_hashes(h: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    return Rolling(mix(h ^ U64(0x7F4A7C15))).of(start, start + window)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _block_rows(window: int):
    def run(batches):
        for batch in batches:
            ids, key = _column(batch, "id"), _column(batch, "key")
            for part in slices(_column(batch, "text"), NOT_SPACE, False):
                a, k, s, c = blocks(part.hashes(), part.first, window)
                text = np.searchsorted(part.first, s, "right") - 1
                row = pa.array(text + part.row)
                yield pa.RecordBatch.from_arrays([key.take(row), ids.take(row), pa.array(signed(a)), pa.array(signed(k)), pa.array((s - part.first[text]).astype(np.int32)), pa.array(c.astype(np.int32))], ["key", "id", "a", "k", "s", "c"])

    return run


def _window_rows(window: int):
    """Rows of single windows: for each text the listed blocks (a, s, c) are taken apart."""

    def run(batches):
        for batch in batches:
            ids, key, listed = _column(batch, "id"), _column(batch, "key"), _column(batch, "listed")
            offsets, flat = listed.offsets.to_numpy(), listed.values
            a, s, c = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for part in slices(_column(batch, "text"), NOT_SPACE, False):
                lo, hi = offsets[part.row], offsets[part.row + part.rows]
                row = np.repeat(np.arange(part.rows), np.diff(offsets[part.row : part.row + part.rows + 1]))
                n = c[lo:hi].astype(np.int64)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, at = np.repeat(row, n), np.repeat(s[lo:hi].astype(np.int64), n) + inner
                w = window_hashes(part.hashes(), part.first[row] + at, window)
                take = pa.array(row + part.row)
                yield pa.RecordBatch.from_arrays([key.take(take), ids.take(take), pa.array(np.repeat(a[lo:hi], n)), pa.array(signed(w)), pa.array(at.astype(np.int32))], ["key", "id", "a", "w", "s"])

    return run


def removed_words(part: Slice, offsets: np.ndarray, s: np.ndarray, c: np.ndarray, window: int) -> np.ndarray:
    """Whether each word stands in a window with a start in [s, s + c), listed per text."""
    lo, hi = offsets[part.row], offsets[part.row + part.rows]
    row = np.repeat(np.arange(part.rows), np.diff(offsets[part.row : part.row + part.rows + 1]))
    begin = part.first[row] + s[lo:hi]
    depth = np.bincount(begin, minlength=len(part.start) + 1)
    depth -= np.bincount(begin + c[lo:hi] - 1 + window, minlength=len(part.start) + 1)
    return np.cumsum(depth)[: len(part.start)] > 0


def kept_texts(part: Slice, gone: np.ndarray) -> list[bytes]:
    """The words of each text that stay, joined by one space."""
    last = np.full(part.rows, -1)
    stay = np.flatnonzero(~gone)
    row = np.searchsorted(part.first, stay, "right") - 1
    last[row] = stay
    mask = np.zeros(len(part.data) + 1, dtype=np.int8)
    mask[part.start[stay]] = 1
    mask[part.end[stay]] -= 1
    mask = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
    space = part.end[np.setdiff1d(stay, last, assume_unique=True)]
    mask[space] = True
    data = part.data.copy()
    data[space] = 0x20
    size = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=size[1:])
    at, out = size[part.offsets], data[mask].tobytes()
    return [out[at[i] : at[i + 1]] for i in range(part.rows)]


def _kept_rows(window: int, with_text: bool):
    def run(batches):
        for batch in batches:
            ids, listed = _column(batch, "id"), _column(batch, "listed")
            listed = listed.fill_null([]) if listed.null_count else listed
            offsets, flat = listed.offsets.to_numpy(), listed.values
            s, c = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            n, lost, sha, kept = [], [], [], []
            for part in slices(_column(batch, "text"), NOT_SPACE, False):
                gone = removed_words(part, offsets, s, c, window)
                total = np.concatenate([[0], np.cumsum(gone)])
                texts = kept_texts(part, gone)
                n.append(part.counts())
                lost.append(total[part.first[1:]] - total[part.first[:-1]])
                sha += [hashlib.sha256(t).hexdigest() for t in texts]
                kept += [t.decode() for t in texts] if with_text else []
            whole = [pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64), pa.int64()) for x in (n, lost)]
            yield pa.RecordBatch.from_arrays([ids, *whole, pa.array(sha, pa.string()), *([pa.array(kept, pa.string())] if with_text else [])], ["id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, with_text: bool = False) -> DataFrame:
    """Words left in each document once every word is removed that stands in a window of ``window`` words (separated by white
    space) whose word sequence also starts in a document with a smaller id. Windows are judged on the input.

    Returns a row per input row: id, n_words, n_removed, kept_sha256 (words joined by one space), and kept_text on request.
    A null text has no words. A row with a null id keeps all its words and removes none elsewhere. Rows with the same id do not
    remove each other's words; a row that repeats id and text gets the same result again, and is looked at once. Other columns are
    ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    once = distinct_texts(src).withColumn("key", F.xxhash64("text"))
    occ = materialize(once.mapInArrow(_block_rows(window), "key long, id long, a long, k long, s int, c int"), "blocks")
    groups = occ.groupBy("a", "k").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    groups = materialize(groups, "groups")
    split = groups.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", F.lit(True).alias("split"))
    wanted = groups.join(split, "a", "left").where("split or first < last").select("a", "k", "first", F.coalesce("split", F.lit(False)).alias("split"))
    met = materialize(occ.join(wanted, ["a", "k"]).where("id > first or split").select("key", "id", "a", "s", "c", "first"), "met")
    listed = met.where("id = first").groupBy("id", "key").agg(F.collect_list(F.struct("a", "s", "c")).alias("listed"))
    single = once.join(listed, ["id", "key"])
    windows = materialize(single.select("key", "id", "text", "listed").mapInArrow(_window_rows(window), "key long, id long, a long, w long, s int"), "windows")
    release(occ, groups)
    earliest = windows.groupBy("a", "w").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    again = windows.join(earliest, ["a", "w"]).where("id > first").select("id", "key", "s", F.lit(1).alias("c"))
    covers = met.where("id > first").select("id", "key", "s", "c").unionByName(again)
    covers = covers.groupBy("id", "key").agg(F.collect_list(F.struct("s", "c")).alias("listed"))
    out = src.withColumn("key", F.xxhash64("text")).join(covers, ["id", "key"], "left").select("id", "text", "listed")
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return out.mapInArrow(_kept_rows(window, with_text), schema).withColumnRenamed("id", id_col)
