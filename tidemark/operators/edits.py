"""Edit distances of many short texts at once, bit-parallel: a bit per character of the one text, a step per character of the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
#: Pairs whose bits are kept in the processor's cache.
BLOCK = 4096


def _padded(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each text as a row filled with zeros, and its length."""
    text = text.cast(pa.large_binary())
    ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    size = np.diff(ends)
    out = np.zeros((len(text), max(int(size.max(initial=0)), 1)), dtype=np.uint8)
    if size.sum():
        data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
        out[np.arange(out.shape[1]) < size[:, None]] = data
    return out, size


def distances(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Levenshtein distance of each text of ``a`` to the one of ``b`` in its place. Texts are ASCII, as normalised titles are; no nulls."""
    x, m = _padded(a)
    y, n = _padded(b)
    out = np.empty(len(m), dtype=np.int64)
    order = np.argsort(-n, kind="stable")
    for at in range(0, len(order), BLOCK):
        rows = order[at : at + BLOCK]
        out[rows] = _block(x[rows], m[rows], y[rows], n[rows])
    return out


def _block(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One block, the texts in ``y`` in descending order of their lengths, so that those not yet at their end come first."""
    known = np.unique(x)
    code = np.full(256, len(known), dtype=np.int64)
    code[known] = np.arange(len(known))
    words, rows, kinds = -(-x.shape[1] // 64), len(m), len(known) + 1
    # Of each character of the alphabet, where it stands in x.
    eq = np.zeros((words, rows * kinds), dtype=np.uint64)
    base = np.arange(rows) * kinds
    for i in range(x.shape[1]):
        inside = np.flatnonzero(m > i)
        eq[i // 64, base[inside] + code[x[inside, i]]] |= _ONE << np.uint64(i % 64)
    plus, minus = np.full((words, rows), _ALL), np.zeros((words, rows), dtype=np.uint64)
    at = base[None, :] + code[y.T]
    left = np.searchsorted(-n, -np.arange(y.shape[1]), "left")
    for j in range(int(n.max(initial=0))):
        live = left[j]
        e, vp, vn = eq[:, at[j, :live]], plus[:, :live], minus[:, :live]
        d = e & vp
        carry = np.zeros(live, dtype=bool)
        for w in range(words):
            s = d[w] + vp[w]
            over = s < d[w]
            s += carry
            carry = over | (s < carry)
            d[w] = s
        d ^= vp
        d |= e
        d |= vn
        hp = ~(d | vp)
        hp |= vn
        hn = d & vp
        top_p, top_n = hp[:-1] >> np.uint64(63), hn[:-1] >> np.uint64(63)
        hp <<= _ONE
        hn <<= _ONE
        hp[0] |= _ONE
        hp[1:] |= top_p
        hn[1:] |= top_n
        np.bitwise_and(hp, d, out=vn)
        d |= hp
        np.invert(d, out=d)
        np.bitwise_or(hn, d, out=vp)
    # The last column's differences, summed down to the end of x.
    total = n.astype(np.int64)
    for w in range(words):
        bits = np.clip(m - 64 * w, 0, 64)
        mask = np.where(bits == 64, _ALL, (_ONE << np.minimum(bits, 63).astype(np.uint64)) - _ONE)
        total += np.bitwise_count(plus[w] & mask).astype(np.int64) - np.bitwise_count(minus[w] & mask).astype(np.int64)
    return total


#: Places that pairs of letters are counted in, and letters that are compared at each end of a text, a bit for each.
PLACES, END = 2048, 64
#: Texts of the one side whose pairs are counted at once.
TILE = 512
#: Pairs whose ends are compared at once.
PAIRS = 8192


def _reversed(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    at = n[:, None] - 1 - np.arange(x.shape[1])
    return np.where(at >= 0, np.take_along_axis(x, np.maximum(at, 0), 1), 0).astype(x.dtype)


def _profile(x: np.ndarray, n: np.ndarray, kinds: int) -> np.ndarray:
    """How many pairs of letters of each text fall into each place. Repeats are numbered, so that products of two rows are no less than the pairs that both have."""
    rows, at = np.nonzero(np.arange(x.shape[1] - 1) < n[:, None] - 1)
    key = rows * np.int64(kinds * kinds) + x[rows, at].astype(np.int64) * kinds + x[rows, at + 1]
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    repeat = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
    rows, pair = np.divmod(key, kinds * kinds)
    place = ((((pair << 8) | np.minimum(repeat, 255)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)).astype(np.int64)
    return np.bincount(rows * PLACES + place, minlength=len(n) * PLACES).reshape(len(n), PLACES).astype(np.float32)


def _ends(x: np.ndarray, size: np.ndarray, kinds: int) -> np.ndarray:
    """Of each text and letter, a bit for each of its first ``size`` places where it stands, the last of them in the highest bit."""
    eq = np.zeros((len(x), kinds), dtype=np.uint64)
    for i in range(min(END, x.shape[1])):
        rows = np.flatnonzero(size > i)
        eq[rows, x[rows, i]] |= _ONE << (END - size[rows] + i).astype(np.uint64)
    return eq.reshape(-1)


def _least_edits(eq: np.ndarray, base: np.ndarray, size: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each pair, the least distance of the one's first ``size`` letters to any beginning of the other, whose letters are the columns of ``y``."""
    plus = np.where(size > 0, _ALL << np.minimum(END - size, END - 1).astype(np.uint64), np.uint64(0))
    minus, e, d, hp, hn = (np.zeros(len(base), dtype=np.uint64) for _ in range(5))
    at, step, now = np.empty_like(base), np.empty_like(base), size.astype(np.int64)
    best = now.copy()
    up, down = hp.view(np.int64), hn.view(np.int64)
    for j in range(len(y)):
        # No later column has less than the letters it is too long by.
        if j % 8 == 0 and np.all(j - size >= best):
            break
        np.add(base, y[j], out=at)
        np.take(eq, at, out=e, mode="clip")
        np.bitwise_and(e, plus, out=d)
        d += plus
        d ^= plus
        d |= e
        d |= minus
        np.bitwise_or(d, plus, out=hp)
        np.invert(hp, out=hp)
        hp |= minus
        np.bitwise_and(plus, d, out=hn)
        now -= np.right_shift(up, 63, out=step)
        now += np.right_shift(down, 63, out=step)
        np.minimum(best, now, out=best)
        hp <<= _ONE
        hp |= _ONE
        hn <<= _ONE
        np.bitwise_and(hp, d, out=minus)
        hp |= d
        np.invert(hp, out=hp)
        np.bitwise_or(hn, hp, out=plus)
    return np.where(size > 0, best, 0)


def similar_across(ta: pa.Array, tb: pa.Array, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all different texts of which 1 - distance / length is ``least`` or more; of one list with itself (``same``), i < j.

    Three bounds drop what cannot be similar, and the distances of the others are taken: lengths; pairs of letters that both texts have, of which an edit
    spoils two at most; and edits of a text's two ends, which lie apart in the other one too.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(ta) or not len(tb):
        return none, none
    (x, m), (y, n) = _padded(ta), _padded(tb)
    # Tiles of like lengths.
    left, right = np.argsort(m, kind="stable"), np.argsort(n, kind="stable")
    x, m, y, n = x[left], m[left], y[right], n[right]
    known = np.unique(np.concatenate([np.unique(x), np.unique(y), [0]]))
    code = np.zeros(256, dtype=np.uint8)
    code[known] = np.arange(len(known))
    x, y, kinds = code[x], code[y], len(known)
    most = lambda longer: np.floor((1 - least) * longer + 1e-9).astype(np.int64)
    ends = (np.minimum(m, END), np.clip(m - END, 0, END))
    eq = (_ends(x, ends[0], kinds), _ends(_reversed(x, m), ends[1], kinds))
    letters = (np.ascontiguousarray(y.T), np.ascontiguousarray(_reversed(y, n).T))
    pairs = _profile(y, n, kinds)
    out = []
    for start in range(0, len(m), TILE):
        stop = min(start + TILE, len(m))
        # Texts of y that are neither too short nor too long for all of the tile.
        fits = np.flatnonzero((n >= m[start] - most(m[start])) & (m[stop - 1] >= n - most(n)))
        if not len(fits):
            continue
        first, last = int(fits[0]), int(fits[-1]) + 1
        longer = np.maximum(m[start:stop, None], n[None, first:last])
        limit = most(longer)
        open_ = (np.abs(m[start:stop, None] - n[None, first:last]) <= limit) & (_profile(x[start:stop], m[start:stop], kinds) @ pairs[first:last].T >= longer - 1 - 2 * limit)
        if same:
            open_ &= np.arange(start, stop)[:, None] < np.arange(first, last)[None, :]
        i, j = np.nonzero(open_)
        i, j = i + start, j + first
        for at in range(0, len(i), PAIRS):
            p, q = i[at : at + PAIRS], j[at : at + PAIRS]
            edits = np.zeros(len(p), dtype=np.int64)
            for bits, size, other in zip(eq, ends, letters, strict=True):
                # Half of what is allowed, and one more, at each end is too much for both: later columns have more than that.
                limits = most(np.maximum(m[p], n[q]))
                half = limits // 2
                columns = int((size[p] + half).max(initial=0))
                edits += np.minimum(_least_edits(bits, p * kinds, size[p], other[:columns][:, q]), half + 1)
                keep = edits <= limits
                p, q, edits = p[keep], q[keep], edits[keep]
            out.append((p, q))
    i, j = (np.concatenate([c[k] for c in out]) if out else none for k in (0, 1))
    longer = np.maximum(m[i], n[j])
    i, j = left[i], right[j]
    edits = distances(ta.take(pa.array(i)), tb.take(pa.array(j)))
    hit = (edits > 0) & (edits <= most(longer))
    i, j = i[hit], j[hit]
    return (np.minimum(i, j), np.maximum(i, j)) if same else (i, j)


def similar_in_group(least: float):
    """Pairs (a, b) of the items of one group (same, right, news_id, t) with similar and different titles, the one on the left and the other on the right,
    or both on the left if the two sides are the same."""

    def run(group: pa.Table) -> pa.Table:
        right = group.column("right")
        one, two = group.filter(pa.compute.invert(right)), group.filter(right)
        same = pa.compute.any(group.column("same")).as_py()
        if same:
            two = one
        text = lambda side: pa.concat_arrays(side.column("t").cast(pa.large_binary()).chunks) if len(side) else pa.array([], pa.large_binary())
        i, j = similar_across(text(one), text(two), least, same)
        return pa.table({"a": one.column("news_id").take(pa.array(i)), "b": two.column("news_id").take(pa.array(j))})

    return run


def within(least: float, shortest: int):
    """Rows (a, b, ta, tb, linked) that are linked, or whose texts of ``shortest`` or more characters are similar: 1 - distance / length of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb, linked = batch.column("ta"), batch.column("tb"), batch.column("linked").to_numpy(zero_copy_only=False)
            na, nb = (np.asarray(pa.compute.binary_length(t)) for t in (ta, tb))
            longer = np.maximum(na, nb)
            open_ = np.flatnonzero(~linked & (np.minimum(na, nb) >= shortest) & (np.abs(na - nb) <= np.floor((1 - least) * longer + 1e-9)))
            hit = linked.copy()
            if len(open_):
                take = pa.array(open_)
                hit[open_] = distances(ta.take(take), tb.take(take)) <= np.floor((1 - least) * longer[open_] + 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(hit))

    return run
