"""Exact n-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A document's set is made of its distinct word shingles in one global order (by hash). Two sets that link share at least c of the
first |x| - ceil(t |x|) + c elements of each (the c-prefix). Small sets enumerate the 2-subsets of their prefix; large sets enter
the inverted lists of its single elements; sets near the boundary do both. The boundary is the size up to which the subsets cost
less than scanning the lists, whose mean length is measured.

Lists (of elements or subsets) are made of rows (key, document), so they are never gathered; what is done with them:

1. Equal sets form classes; a class is its smallest document.
2. Stars: a list's hub is the member most of whose lists others share too, the most central one. Each class is verified against
   the hub met in most of its lists, its pivot. The linked ones give first components.
3. Pivot groups: a class near its pivot p is described by the elements in which it differs from p. |x - y| + |y - x| follows from
   these differences and what they have in common, so two classes of a group of which one does not link with p can only link if
   their differences overlap, and by how much is known. A prefix join on the differences, rarest first, finds such pairs. A group of
   thousands of near copies thus costs about its differences, not the square of its size.
4. Lists across groups: lists that one group has to itself are done. The others give the pairs across groups and components that
   share enough lists, without pairing rows of one group. Lists with too many of them (a passage met everywhere) are skipped: a set
   loses no link to them while fewer of its lists are skipped than any two linked sets share. Sets for which this does not hold
   meet each other in a prefix join on whole sets in which elements that cost least stand first. From which length on lists are skipped
   is chosen by cost: pairs made in lists against elements of whole sets.
5. The pairs of 3 and 4 are verified too, on whole texts; their links join components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.bytetext import NOT_SPACE, U64, Rolling, Slice, mix, signed, slices
from tidemark.llm.components import components
from tidemark.llm.storage import distinct_texts, materialize, release

#: A star joins only what shares this part of its lists; other links are found across components.
STAR = 0.6
#: What an element of a whole set costs, in pairs of rows of a list: a pair is made, counted and compared with the skipped lists, an element is ranked.
WHOLE = 0.25


def prefix(n, percent: int):
    """|x| - ceil(t |x|) + 1; works on numbers and arrays."""
    return n - (percent * n + 99) // 100 + 1


def slack(n, percent: int):
    """How many elements beyond the prefix are listed, so that this many lists of a set may be skipped."""
    return (prefix(n, percent) + 2) // 3 + 3


def shingle_sets(part: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin."""
    n, first = part.counts(), part.first
    if not len(part.start):
        return np.zeros(0, dtype=U64), np.zeros(part.rows + 1, dtype=np.int64)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(part.rows), count)
    start = first[row] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(n[row], k)
    h = mix(Rolling(mix(part.hashes())).of(start, start + size) + size.astype(U64))
    order = np.argsort(h, kind="stable")
    small = row[order].astype(np.int16 if part.rows < 32_000 else np.int32)
    order = order[np.argsort(small, kind="stable")]
    h, row = h[order], row[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(part.rows + 1))


def _set_rows(k: int, percent: int):
    """id, size, class hash and listed prefix of each text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1), NOT_SPACE, True):
                h, first = shingle_sets(part, k)
                n = np.diff(first)
                sums = []
                for salt in (0x2545F491, 0x9E6C63D0):
                    total = np.zeros(len(h) + 1, dtype=U64)
                    np.cumsum(mix(h ^ U64(salt)), out=total[1:])
                    sums.append(pa.array(signed(total[first[1:]] - total[first[:-1]])))
                listed = np.minimum(n, prefix(n, percent) + slack(n, percent)) * (n > 0)
                at = np.repeat(first[:-1], listed) + np.arange(listed.sum()) - np.repeat(np.cumsum(listed) - listed, listed)
                offsets = np.concatenate([[0], np.cumsum(listed)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.row, part.rows), pa.array(n.astype(np.int32)), *sums, pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(h[at])))], ["id", "n", "c1", "c2", "listed"])

    return run


def _key_rows(boundary: int, percent: int, exact_below: int):
    """Rows (key, id, n): 2-subsets of small sets, single elements of large ones."""

    def run(batches):
        for batch in batches:
            ids, n = batch.column(0), batch.column(1).to_numpy().astype(np.int64)
            offsets, flat = batch.column(2).offsets.to_numpy().astype(np.int64), batch.column(2).values.to_numpy().view(U64)
            keys, rows = [], []
            size = np.diff(offsets)
            large = np.flatnonzero((n >= exact_below) & (n > percent * boundary // 100))
            at = np.repeat(offsets[large], size[large]) + np.arange(size[large].sum()) - np.repeat(np.cumsum(size[large]) - size[large], size[large])
            keys.append(flat[at] | U64(1))
            rows.append(np.repeat(large, size[large]))
            small = np.flatnonzero((n >= exact_below) & (n <= boundary))
            for s in np.unique(size[small]):
                which = small[size[small] == s]
                a, b = np.triu_indices(int(s), 1)
                x = flat[offsets[which][:, None] + np.arange(s)]
                keys.append((mix(x[:, a] * U64(0xD6E8FEB86659FD93) + x[:, b]) & ~U64(1)).ravel())
                rows.append(np.repeat(which, len(a)))
            row = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), ids.take(row), batch.column(1).take(row)], ["key", "id", "n"])

    return run


def _overlap_rows(k: int, percent: int, differences: bool):
    """For each pair of texts (a, b): whether they link; with ``differences`` also both sizes and, where they are no more than a's
    elements, the elements that only one of them has."""

    def sets(ids: np.ndarray, text: pa.Array) -> list[np.ndarray]:
        # Neighbouring rows often hold one document; an id can have several texts.
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (ids[1:] != ids[:-1]) | pc.not_equal(text.slice(1), text.slice(0, len(text) - 1)).fill_null(True).to_numpy(zero_copy_only=False)
        out = []
        for part in slices(text.take(pa.array(np.flatnonzero(new))), NOT_SPACE, True):
            h, first = shingle_sets(part, k)
            out += [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        which = np.cumsum(new) - 1
        return [out[i] for i in which]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                on, sizes, apart = np.zeros(len(a), dtype=bool), [], []
                for i, (x, y) in enumerate(zip(sets(a, batch.column(2)), sets(b, batch.column(3)), strict=True)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    on[i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
                    if differences:
                        sizes.append((len(x), len(y)))
                        apart.append(signed(np.setxor1d(x, y, assume_unique=True)) if len(y) <= 2 * both else None)
                more = [pa.array([s[0] for s in sizes], pa.int32()), pa.array([s[1] for s in sizes], pa.int32()), pa.array(apart, pa.list_(pa.int64()))] if differences else []
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(on), *more], ["a", "b", "linked", *(["n", "np", "apart"] if differences else [])])

    return run


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int, differences: bool = False) -> DataFrame:
    """The pairs (a, b) with what ``_overlap_rows`` tells of them. A text moves once per document and once per pair it is the first of."""
    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_overlap_rows(k, percent, differences), "a long, b long, linked boolean" + (", n int, np int, apart array<long>" if differences else ""))


def similar_size(a: str, b: str, percent: int) -> F.Column:
    return F.expr(f"100L * least({a}, {b}) >= {percent}L * greatest({a}, {b})")


def cost_boundary(lists: DataFrame, percent: int, exact_below: int) -> int:
    """The largest size whose 2-subsets are fewer than its listed elements plus the entries of their lists. The entries are the
    geometric mean of the lengths that rows see, which a few very long lists do not move, measured on a 64th of all keys."""
    sizes = lists.where("pmod(shiftright(key, 8), 64) = 0").groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("c"))
    got = sizes.agg(F.sum(F.col("c") * F.ln("c")).alias("s2"), F.sum("c").alias("s1")).first()
    scan = float(np.exp(got.s2 / got.s1)) if got.s1 else 1.0
    n = exact_below
    while (min(n, prefix(n, percent) + slack(n, percent)) - 1) / 2 <= 1 + scan:
        n += 1
    return n - 1


def _sure(n: str, percent: int) -> F.Column:
    """How many listed elements linked sets share at least, the smaller of which has ``n`` elements: one more than its slack, but no more
    than they have in common. For subset keys, the 2-subsets of these."""
    c = f"least(({n} - ({percent}L * {n} + 99) div 100 + 3) div 3 + 4, ({percent}L * {n} + 99) div 100)"
    return F.expr(f"if(subset, {c} * ({c} - 1) div 2, {c})")


def stars(shared: DataFrame, multiple: DataFrame, boundary: int, percent: int) -> DataFrame:
    """a, b: each class and its pivot, the hub met in most of its lists, if they are at least a ``STAR`` of its lists."""
    e = f"least(n, n - ({percent}L * n + 99) div 100 + 1 + (n - ({percent}L * n + 99) div 100 + 3) div 3 + 3)"
    listed = F.expr(f"if(n > {percent * boundary // 100}, {e}, 0) + if(n <= {boundary}, {e} * ({e} - 1) div 2, 0)")
    central = shared.groupBy("rep", "n").agg(F.count(F.lit(1)).alias("met")).select("rep", "n", F.floor(100 * F.col("met") / F.greatest(listed, F.lit(1))).alias("share"))
    scored = shared.join(central.join(multiple.select(F.col("id").alias("rep")), "rep", "left_anti"), ["rep", "n"])
    hub = scored.groupBy("key").agg(F.max(F.struct("share", (-F.col("rep")).alias("rep"), "n")).alias("x"), F.count(F.lit(1)).alias("m")).where("m > 1")
    hub = hub.select("key", (-F.col("x.rep")).alias("hub"), F.col("x.n").alias("hub_n"))
    met = scored.join(hub, "key").where("rep <> hub and 2 * least(n, hub_n) >= greatest(n, hub_n)")
    met = met.groupBy("rep", "n", "hub", F.expr("key & 1 = 0").alias("subset")).agg(F.count(F.lit(1)).alias("met"))
    enough = F.expr(f"if(subset, {e} * ({e} - 1) / 2 * {STAR * STAR}D, {e} * {STAR}D)")
    best = met.where(F.col("met") >= enough).groupBy("rep").agg(F.max(F.struct("met", (-F.col("hub")).alias("h"))).alias("x"))
    return best.select(F.col("rep").alias("a"), (-F.col("x.h")).alias("b"))


def difference_pairs(near: DataFrame, part: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs a < b of one pivot group and different components. ``near``: a, p, linked, n, np, apart.

    With z elements in which a class differs from the pivot, x and y link if and only if (100 + P)(zx + zy - 2 o) <= (100 - P)(nx + ny),
    o being what their differences have in common. Let x not link with p. Then o >= 1; o >= zx - nx (100 - P) / P, as o <= zy; and
    2 o (100 + P) > (100 + P) zy + (100 - P)(np - ny). Each bounds a prefix of the differences, rarest first, that holds a common element.
    """
    open_groups = near.where("not linked").select("p").distinct()
    rows = near.join(open_groups, "p").withColumn("z", F.size("apart").cast("long")).join(part, F.col("a") == F.col("rep"), "left")
    rows = rows.select("p", "a", "linked", F.col("n").cast("long").alias("n"), F.col("np").cast("long").alias("np"), "z", F.coalesce("component", "a").alias("g"), F.explode("apart").alias("key"))
    rows = materialize(rows, "differences")
    often = rows.groupBy("p", "key").agg(F.count(F.lit(1)).alias("m"))
    ranked = rows.join(often, ["p", "key"]).withColumn("r", F.row_number().over(W.partitionBy("a").orderBy("m", "key"))).where("m > 1")
    ranked = ranked.withColumn("as_second", F.expr(f"z - greatest(1L, cast(floor(({100 + percent}L * z + {100 - percent}L * (np - n)) / {2 * (100 + percent)}) as long) + 1L) + 1L"))
    ranked = ranked.withColumn("as_first", F.expr(f"z - greatest(1L, z - {100 - percent}L * n div {percent}L) + 1L"))
    x = ranked.where("not linked and r <= as_first").select("p", "key", *(F.col(c).alias(f"{c}x") for c in ("a", "n", "z", "r", "g")))
    y = ranked.where("r <= as_second").select("p", "key", *(F.col(c).alias(f"{c}y") for c in ("a", "n", "z", "r", "g")))
    enough = F.expr(f"{2 * (100 + percent)}L * (1 + least(zx - rx, zy - ry)) >= {100 + percent}L * (zx + zy) - {100 - percent}L * (nx + ny)")
    met = x.join(y, ["p", "key"]).where("ax <> ay and gx <> gy").where(similar_size("nx", "ny", percent) & enough)
    return met.select(F.least("ax", "ay").alias("a"), F.greatest("ax", "ay").alias("b")).distinct()


def weights(rows: DataFrame) -> DataFrame:
    """key, entries and pairs across groups of each list that more than one group has; pairs over entries is the weight."""
    per = rows.groupBy("key", "group").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("key")
    return per.agg(F.sum("c").alias("entries"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("across")).where("across > 0")


def across_groups(rows: DataFrame, on: F.Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of rows (key, rep, n, part, group) of one list that are of different groups and components, and fulfil ``on``: first
    the pairs of groups, then the rows of each, so that rows of one group are never paired."""
    groups = rows.select("key", "group").distinct()
    met = groups.select("key", F.col("group").alias("ga")).join(groups.select("key", F.col("group").alias("gb")), "key").where("ga < gb")
    columns = ("rep", "n", "part", *extra)
    for side in "ab":
        met = met.join(rows.select("key", F.col("group").alias(f"g{side}"), *(F.col(c).alias(f"{c}_{side}") for c in columns)), ["key", f"g{side}"])
    met = met.where("rep_a <> rep_b and part_a <> part_b").where(on)
    return met.select("key", F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"), F.least("n_a", "n_b").alias("n"))


def _skipped(keys: DataFrame, hot: DataFrame) -> DataFrame:
    """How many lists of each class are skipped, by kind of key."""
    return keys.join(hot, "key").groupBy("rep", "n", F.expr("key & 1 = 0").alias("subset")).agg(F.count(F.lit(1)).alias("lost"))


def _low(rows: DataFrame, percent: int) -> DataFrame:
    return rows.withColumn("low", F.expr(f"({percent}L * n + 99) div 100"))


def cost_level(rows: DataFrame, lists: DataFrame, percent: int) -> int:
    """The level (power of two of a list's weight) up to which lists are paired. A class whose k-th heaviest list lies above it, k being
    what linked sets share, has to enter the join on whole sets. Both costs are summed by level; the cheapest level is taken."""
    by_level = {r.level: r.cost for r in lists.groupBy("level").agg(F.sum("across").alias("cost")).collect()}
    seen = _low(rows.join(lists.select("key", "level"), "key").withColumn("subset", F.expr("key & 1 = 0")), percent)
    seen = seen.groupBy("rep", "n", "low", "subset", "level").agg(F.count(F.lit(1)).alias("c"))
    seen = seen.withColumn("above", F.sum("c").over(W.partitionBy("rep", "n", "subset").orderBy(F.desc("level"))))
    lost = seen.where(F.col("above") >= _sure("low", percent)).groupBy("rep", "n").agg(F.max("level").alias("level"))
    whole = {r.level: r.cost for r in lost.groupBy("level").agg(F.sum("n").alias("cost")).collect()}
    return min(
        sorted({-64, *by_level}),
        key=lambda t: sum(c for level, c in by_level.items() if level <= t) + WHOLE * sum(c for level, c in whole.items() if level > t),
    )


def _skipped_too_many(skipped: DataFrame, percent: int) -> DataFrame:
    """Classes with as many skipped lists as linked sets surely share, or more."""
    return _low(skipped, percent).where(F.col("lost") >= _sure("low", percent)).select("rep").distinct()


def list_pairs(rows: DataFrame, percent: int, skipped: DataFrame) -> DataFrame:
    """Pairs a < b across groups that share as many lists as two linked sets do at least, less those that may be among the skipped."""
    met = across_groups(rows, similar_size("n_a", "n_b", percent))
    met = met.groupBy("a", "b", "n", F.expr("key & 1 = 0").alias("subset")).agg(F.count(F.lit(1)).alias("met"))
    for side in ("a", "b"):
        lost = skipped.groupBy(F.col("rep").alias(side), "subset").agg(F.max("lost").alias(f"lost_{side}"))
        met = met.join(lost, [side, "subset"], "left")
    hidden = F.least(F.coalesce("lost_a", F.lit(0)), F.coalesce("lost_b", F.lit(0)))
    return met.where(F.col("met") >= _sure("n", percent) - hidden).select("a", "b").distinct()


def _whole_rows(k: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1), NOT_SPACE, True):
                h, first = shingle_sets(part, k)
                row = np.repeat(np.arange(part.rows), np.diff(first))
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), batch.column(0).take(pa.array(row + part.row)), pa.array(np.diff(first)[row].astype(np.int32))], ["key", "rep", "n"])

    return run


def whole_pairs(lost: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Candidate pairs of the given classes (rep, part, group) across groups: those sharing one of their |x| - ceil(t |x|) + 1 elements that
    stand in the lightest lists, at places from which enough elements follow in both (the first common element of a linked pair
    stands at such places)."""
    rows = texts.join(lost.select(F.col("rep").alias("id")), "id", "left_semi").mapInArrow(_whole_rows(k), "key long, rep long, n int").distinct()
    rows = materialize(rows.join(lost, "rep"), "whole")
    often = weights(rows).select("key", (F.col("across") / F.col("entries")).alias("w"))
    ranked = rows.join(often, "key", "left").withColumn("r", F.row_number().over(W.partitionBy("rep", "n").orderBy(F.coalesce("w", F.lit(0.0)), "key")))
    kept = ranked.where(F.col("w").isNotNull()).where(F.col("r") <= F.expr(f"n - ({percent}L * n + 99) div 100 + 1"))
    enough = F.expr(f"{100 + percent}L * (1 + least(n_a - r_a, n_b - r_b)) >= {percent}L * (n_a + n_b)")
    return across_groups(kept, similar_size("n_a", "n_b", percent) & enough, ("r",)).select("a", "b").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """Classes of documents linked by 100 * |A and B| >= ``percent`` * |A or B| over distinct ``k``-word shingles of the lower-cased
    (A-Z) text: id, n_shingles, component_id (smallest id reachable) and n_copies (documents with an equal set, itself included).

    One row per input row. A text of fewer words than k has its whole word sequence as its one shingle. Null and empty texts have
    an empty set and link with nothing, as do rows with a null id. Rows that repeat an id count as one document, linked by any of
    its texts; however often a row is repeated, its text is compared once. Other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = materialize(src.mapInArrow(_set_rows(k, percent), "id long, n int, c1 long, c2 long, listed array<long>"), "sets")
    # Sets below this size link only with equal ones: one element more is too much.
    exact_below = next(n for n in range(1, 101) if 100 * n >= percent * (n + 1))
    real = sets.where("n > 0 and id is not null")
    texts = distinct_texts(src)
    classes = real.groupBy("n", "c1", "c2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_copies"))
    member = materialize(real.select("id", "n", "c1", "c2").join(classes, ["n", "c1", "c2"]).select("id", "n", "c1", "c2", "rep", "n_copies").distinct(), "members")
    owner = materialize(member.groupBy("id").agg(F.min("rep").alias("rep"), F.max("n_copies").alias("n_copies"), F.count(F.lit(1)).alias("classes")), "owners")
    multiple = materialize(owner.where("classes > 1").select("id", F.col("rep").alias("first")), "multiple")
    listed = real.where(F.col("n") >= exact_below).select("id", "n", "listed")
    boundary = cost_boundary(listed.select(F.explode("listed").alias("key")), percent, exact_below)
    keys = listed.mapInArrow(_key_rows(boundary, percent, exact_below), "key long, id long, n int")
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    shared = keys.join(met, "key").join(member.select("id", "n", "rep").distinct(), ["id", "n"]).select("key", "rep", "n").distinct()
    shared = materialize(shared, "lists")
    pivots = materialize(stars(shared, multiple, boundary, percent), "stars")
    checked = materialize(verify(pivots, texts, k, percent, differences=True).withColumnRenamed("b", "p"), "checked")
    # An id with several sets joins their classes.
    several = member.join(multiple, "id").where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    links = checked.where("linked").select("a", F.col("p").alias("b")).unionByName(several)
    part = materialize(components(links, "a", "b").withColumnRenamed("node", "rep"), "parts")
    # A pivot of others is the centre of its own group.
    near = checked.where("apart is not null").join(checked.where("apart is not null").select(F.col("p").alias("a")).distinct(), "a", "left_anti")
    near = materialize(near, "near")
    placed = shared.join(part, "rep", "left").join(near.select(F.col("a").alias("rep"), "p"), "rep", "left")
    placed = materialize(placed.select("key", "rep", "n", F.coalesce("component", "rep").alias("part"), F.coalesce("p", "rep").alias("group")), "placed")
    lists = materialize(weights(placed).withColumn("level", F.floor(F.log2(F.col("across") / F.col("entries"))).cast("int")), "weights")
    level = cost_level(placed, lists, percent)
    skipped = materialize(_skipped(placed, lists.where(F.col("level") > level).select("key")), "skipped")
    found = list_pairs(placed.join(lists.where(F.col("level") <= level).select("key"), "key"), percent, skipped)
    lost = placed.select("rep", "part", "group").distinct().join(_skipped_too_many(skipped, percent), "rep")
    found = found.unionByName(whole_pairs(materialize(lost, "lost"), texts, k, percent)).unionByName(difference_pairs(near, part, percent))
    pairs = materialize(found.distinct(), "pairs")
    release(shared, pivots, placed, lists, skipped)
    more = verify(pairs, texts, k, percent).where("linked").select("a", "b")
    for side in ("a", "b"):
        more = more.join(part.select(F.col("rep").alias(side), F.col("component").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    joined = components(more.select("ca", "cb"), "ca", "cb").select(F.col("node").alias("part"), F.col("component").alias("whole"))
    rep = owner.join(part, "rep", "left").withColumn("part", F.coalesce("component", "rep")).join(joined, "part", "left")
    rep = rep.select("id", "n_copies", F.coalesce("whole", "part").alias("component"))
    out = sets.select("id", "n").join(rep, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"))
