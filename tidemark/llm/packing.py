"""Packing token sequences by shortest-pack-first over the histogram of lengths.

1. Each task tokenizes its documents, cuts them at multiples of the sequence size and writes a slim row per document: tokens, check
   sums of its pieces, and the document's rank among those of its task with the same rest. Neither texts nor ids are shuffled.
2. The histogram of rests (at most one row per length) goes to the driver. Lengths are placed longest first, each into the shortest
   pack so far, for all documents of a length at once: what is kept are pack patterns and how often each is used.
3. A document's rank among all of its length is its rank in the task plus what earlier tasks have. Ranks of a length are dealt to the
   slots of the patterns in order, which gives sequence and offset.

Full pieces are sequences of their own. A text's pieces are encoded word by word: between a visible character and a blank that
stands alone before another one, the tokenizer never joins anything, so that equal words of a batch are encoded once.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.bytetext import buffers, pieces
from tidemark.llm.storage import materialize

#: Bytes of texts whose words are encoded together, and of the texts made of these words.
SLICE = 8 << 20
CHUNK = 1 << 16

_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
#: First bytes of two-byte characters beyond U+00BF: none of them is white space.
_LEAD = np.zeros(256, dtype=bool)
_LEAD[0xC3:0xE0] = True


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = _VISIBLE & ~_LETTER
_MARK[0x30:0x3A] = False


def word_starts(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray = _MARK) -> np.ndarray:
    """Where texts can be cut so that their parts encode to the same ids: at text starts, before a single blank between visible
    characters, around a single line end between them, and between a letter and one of ``marks``."""
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    if n > 2:
        after = _VISIBLE[data] | _LEAD[data]
        before = _VISIBLE[data]
        before[1:] |= (data[1:] >= 0x80) & _LEAD[data[:-1]]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        inner = np.zeros(n, dtype=bool)
        inner[1:-1] = before[:-2] & after[2:] & ~edge[1 : n - 1] & ~edge[2:n]
        cut[:n] = inner & ((data == 0x20) | (data == 0x0A))
        cut[1:] |= inner & (data == 0x0A)
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut[1:n] |= letter[:-1] & marks[data[1:]]
    cut[offsets] = True
    cut[n] = False
    return np.flatnonzero(cut)


def _shown_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the byte at each place ends a visible character."""
    return _VISIBLE[data[at]] | ((data[at] >= 0x80) & _LEAD[data[at - 1]])


class Encoder:
    """Token ids of whole batches; each distinct word of a slice is encoded once.

    Words that begin with a blank and have visible ends keep their ids when they stand one after the other, so they are encoded as
    long texts. Where words begin follows from the bytes that each token stands for.
    """

    def __init__(self, definition: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_buffer(definition)
        added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max([*vocabulary.values(), *added], default=0) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)  # a character of the byte alphabet per byte
        for i, n in added.items():
            self.bytes[i] = n
        # An added token is found before words are: no cut may fall into one.
        inside = b"".join(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        if b" " in inside or b"\n" in inside:
            raise ValueError("added tokens with blanks are not supported")
        self.marks = _MARK.copy()
        self.marks[list(inside)] = False

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of some distinct words: all ids, and where each word's begin and how many they are."""
        if not len(words):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        data, offsets = buffers(words)
        start, size = offsets[:-1], np.diff(offsets)
        plain = size > 1
        p = np.flatnonzero(plain)
        plain[p] = (data[start[p]] == 0x20) & (_VISIBLE[data[start[p] + 1]] | _LEAD[data[start[p] + 1]]) & _shown_before(data, start[p] + size[p] - 1)
        joined, ends = data[np.repeat(plain, size)], np.cumsum(size[plain])
        first, count = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
        parts: list[np.ndarray] = []
        if len(ends):
            cuts = np.unique(np.append(0, ends[np.minimum(np.searchsorted(ends, np.arange(CHUNK, ends[-1] + CHUNK, CHUNK)), len(ends) - 1)]))
            parts = self.ids([joined[x:y].tobytes().decode() for x, y in zip(cuts[:-1], cuts[1:], strict=True)])
            read = np.cumsum(self.bytes[np.concatenate(parts)])
            upto = np.searchsorted(read, ends)
            if not (read[np.minimum(upto, len(read) - 1)] == ends).all():
                raise ValueError("a token of this tokenizer reaches over a blank")
            count[plain] = np.diff(upto, prepend=-1)
            first[plain] = upto + 1 - count[plain]
        done = sum(map(len, parts))
        others = self.ids(words.filter(pa.array(~plain)).to_pylist())
        count[~plain] = [len(x) for x in others]
        first[~plain] = done + np.cumsum(count[~plain]) - count[~plain]
        return np.concatenate([*parts, *others]), first, count

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """first row, ids of consecutive texts one after the other, and where each text's begin."""
        for data, offsets, row in pieces(column, SLICE):
            start = word_starts(data, offsets, self.marks)
            start = start[start < len(data)]
            bounds = np.append(start, len(data))
            words = pa.StringArray.from_buffers(len(start), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
            flat, first, count = self.words(words.dictionary)
            place = words.indices.to_numpy()
            size = count[place]
            end = np.cumsum(size)
            ids = flat[np.arange(size.sum()) + np.repeat(first[place] - end + size, size)]
            yield row, ids, np.append(0, end)[np.searchsorted(start, offsets)]


_ENCODERS: dict[bytes, Encoder] = {}


def encoder_of(definition: bytes) -> Encoder:
    """One encoder per worker process, whatever tasks it runs."""
    key = hashlib.sha256(definition).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def _document_rows(definition: bytes, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = encoder_of(definition), TaskContext.get().partitionId()
        rests, fulls = np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            for row, ids, first in encoder.encode(batch.column(1)):
                total, sums = [], []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    total.append(len(own))
                    sums.append([zlib.crc32(own[i : i + size].tobytes()) for i in range(0, len(own), size)])
                tokens = np.array(total, dtype=np.int64)
                rest = tokens % size
                # Ranks go on from batch to batch of the task, length by length.
                order = np.argsort(rest, kind="stable")
                begin = np.searchsorted(rest[order], rest[order])
                rank = np.empty(len(rest), dtype=np.int64)
                rank[order] = np.arange(len(rest)) - begin + rests[rest[order]]
                rests += np.bincount(rest, minlength=size)
                full = tokens // size
                before = fulls + np.cumsum(full) - full
                fulls += int(full.sum())
                names = ["id", "task", "tokens", "rest", "rank", "fulls", "sums"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(tokens)), pa.array(np.full(len(tokens), task, dtype=np.int32)), pa.array(tokens), pa.array(rest.astype(np.int32)), pa.array(rank), pa.array(before), pa.array(sums, pa.list_(pa.int64()))], names
                )

    return run


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Pack patterns as runs of (length, how many) with the number of packs of each: lengths are placed longest first into the shortest pack.

    As if documents were placed one by one: packs of equal fill take one each before any takes a second. Where no pack has room, new
    packs are opened one after the other and filled with the length.
    """
    by_room: dict[int, dict[tuple, int]] = {}
    rooms: list[int] = []  # negative; those without packs are skipped

    def add(room: int, runs: tuple, count: int) -> None:
        if count:
            if not by_room.get(room):
                heapq.heappush(rooms, -room)
                by_room[room] = {}
            by_room[room][runs] = by_room[room].get(runs, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while rooms and not by_room[-rooms[0]]:
                heapq.heappop(rooms)
            if not rooms or -rooms[0] < length:
                each = size // length
                add(size - each * length, ((length, each),), left // each)
                add(size - left % each * length, ((length, left % each),), int(left % each > 0))
                break
            room = -rooms[0]
            runs = next(iter(by_room[room]))
            packs = by_room[room].pop(runs)
            taken = min(packs, left)
            if packs > taken:
                by_room[room][runs] = packs - taken
            grown = (*runs[:-1], (length, runs[-1][1] + 1)) if runs[-1][0] == length else (*runs, (length, 1))
            add(room - length, grown, taken)
            left -= taken
    return [(runs, count) for room in sorted(by_room) for runs, count in by_room[room].items()]


class Slots:
    """For each length the runs of pattern slots in the order in which ranks are dealt to them."""

    def __init__(self, patterns: list[tuple[tuple[tuple[int, int], ...], int]], size: int, first_sequence: int):
        rows, sequence = [], first_sequence
        for runs, count in patterns:
            fill = sum(length * many for length, many in runs)
            padded = fill if fill & (fill - 1) == 0 else size
            at = 0
            for length, many in runs:
                rows.append((length, many * count, count, sequence, at, padded))
                at += length * many
            sequence += count
        table = np.array(sorted(rows, key=lambda r: (r[0], r[3])), dtype=np.int64).reshape(-1, 6)
        self.length, self.room, self.count, self.sequence, self.at, self.padded = table.T
        dealt = np.cumsum(self.room) - self.room
        # Ranks start anew with each length.
        self.base = dealt - dealt[np.searchsorted(self.length, self.length)] if len(table) else dealt
        self.key = dealt
        self.lengths = np.searchsorted(self.length, np.arange(size + 1))

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """sequence, offset and padded length of the document with this rank among those of its length."""
        at = np.searchsorted(self.key, self.key[self.lengths[length]] + rank, "right") - 1
        inside = rank - self.base[at]
        return self.sequence[at] + inside % self.count[at], self.at[at] + inside // self.count[at] * length, self.padded[at]


def _piece_rows(slots: Slots, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rest, rank, fulls = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            many = -(-tokens // size)
            row = np.repeat(np.arange(len(tokens)), many)
            part = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = part * size
            length = np.minimum(size, tokens[row] - start)
            sequence, offset, padded = fulls[row] + part, np.zeros(len(row), dtype=np.int64), np.full(len(row), size)
            last = np.flatnonzero(length < size)
            sequence[last], offset[last], padded[last] = slots.of(rest[row[last]].astype(np.int64), rank[row[last]])
            arrays = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), batch.column(5).flatten(), pa.array(tokens[row]), pa.array(sequence), pa.array(offset), pa.array(padded)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "start", "length", "sum", "tokens", "sequence", "offset", "padded"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents packed into sequences of at most ``size`` tokens: id, start, length, ids_crc32 (of the piece's ids as
    little-endian unsigned 32-bit integers), doc_tokens (``end_id`` included), sequence_id, offset, and padded_to (``size``, or what
    the sequence holds where that is a power of two). ``tokenizer`` is the path of a tokenizer file, read on the driver.

    Null and empty texts hold the end token alone. Each row is a document of its own, repeated rows and rows with null ids included. An
    empty table gives no pieces. Other columns are ignored.
    """
    definition = Path(tokenizer).read_bytes()
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    own = "id long, task int, tokens long, rest int, rank long, fulls long, sums array<long>"
    rows = materialize(src.mapInArrow(_document_rows(definition, size, end_id), own), "pieces")
    # Rest 0 stands for full pieces; a task has one row per length.
    counts = rows.where("rest > 0").groupBy("task", "rest").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.unionByName(rows.groupBy("task").agg(F.sum(F.expr(f"tokens div {size}")).alias("n")).withColumn("rest", F.lit(0)))
    counts = materialize(counts, "lengths")
    histogram = {r.rest: r.n for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    slots = Slots(shortest_pack_first({k: n for k, n in histogram.items() if k}, size), size, histogram.get(0, 0))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("rest").orderBy("task").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("task", "rest", F.coalesce("before", F.lit(0)).alias("before"))
    full = before.where("rest = 0").select("task", F.col("before").alias("before_full"))
    ranked = rows.join(full, "task").join(before.where("rest > 0"), ["task", "rest"], "left")
    ranked = ranked.select("id", "tokens", "rest", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"), (F.col("fulls") + F.col("before_full")).alias("fulls"), "sums")
    out = ranked.mapInArrow(_piece_rows(slots, size), "id long, start long, length long, sum long, tokens long, sequence long, offset long, padded long")
    return out.toDF(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to")
