"""Word kernels over Arrow string buffers: whole batches at once as byte arrays, no Python loop per word or row.

Both word definitions of this subpackage separate words at ASCII bytes only, so they can be applied to UTF-8 bytes directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(0x5EED)
#: A random odd 64-bit value for each byte, the base of the rolling hash and its inverse modulo 2**64.
BYTE_VALUE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | U64(1)
BASE = U64(0x9E3779B97F4A7C15 | 5)
BASE_INVERSE = U64(pow(int(BASE), -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, a-z and everything beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        m = 1 << max(21, int(n - 1).bit_length())
        for key, base in (("p", BASE), ("q", BASE_INVERSE)):
            step = np.full(m, base, dtype=U64)
            step[0] = 1
            _POWERS[key] = np.multiply.accumulate(step)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(32)
    return x


class Rolling:
    """Hashes of arbitrary ranges of a sequence of 64-bit values, equal for equal ranges wherever they stand."""

    def __init__(self, values: np.ndarray):
        p, self.q = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * p[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.q[start])


class Slice:
    """The words of consecutive texts: byte ranges [start, end) in ``data`` and, for text i, words first[i]..first[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row: int, table: np.ndarray, lower: bool):
        self.row, self.offsets = row, offsets
        self.data = LOWER[data] if lower else data
        self.inside = inside = table[self.data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(len(data), dtype=bool)
        before[:1], before[1:] = True, ~inside[:-1]
        self.start = np.flatnonzero(inside & (before | edge[:-1]))
        after = np.empty(len(data), dtype=bool)
        after[-1:], after[:-1] = True, ~inside[1:]
        self.end = np.flatnonzero(inside & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return Rolling(BYTE_VALUE[self.data]).of(self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Groups of whole texts of about ``most`` bytes (a longer text comes alone): bytes, offsets, first row."""
    data, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], row
        row = to


def slices(column: pa.Array, table: np.ndarray, lower: bool, most: int = 1 << 20) -> Iterator[Slice]:
    for data, offsets, row in pieces(column, most):
        yield Slice(data, offsets, row, table, lower)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def hash_words(words: list[bytes]) -> np.ndarray:
    """``Slice.hashes`` of given words."""
    if not words:
        return np.zeros(0, dtype=U64)
    size = np.array([len(w) for w in words])
    end = np.cumsum(size)
    return Rolling(BYTE_VALUE[np.frombuffer(b"".join(words), dtype=np.uint8)]).of(end - size, end)


def split_words(text: str | None, table: np.ndarray, lower: bool) -> list[bytes]:
    """The words of one small text (phrases, templates)."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    s = Slice(raw, np.array([0, len(raw)]), 0, table, lower)
    return [s.word(i) for i in range(len(s.start))]
