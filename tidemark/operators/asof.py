"""As-of and interval joins by union and one pass over each key's rows in order: one shuffle on the key, no range blow-up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.monthly import like_before


def asof_join(probes: DataFrame, rows: DataFrame, key: str, at: str, date: str, values: list[str], strict: bool = False, per_field: bool = False, any_of: list[str] | None = None) -> DataFrame:
    """``probes`` (key, at, ...) with the values and the date of the last row at or before ``at`` (before it, if ``strict``).

    ``per_field`` carries each value on its own from its last non-null row; ``any_of`` skips rows without any of these values.
    Of rows with one date the last by values wins.
    """
    if any_of:
        rows = rows.where(F.coalesce(*any_of).isNotNull())
    side = 0 if strict else 2
    left = probes.select(F.col(key), F.col(at).alias("__t"), F.lit(side).alias("__side"), F.struct(*probes.columns).alias("__probe"), F.lit(None).cast(rows.select(F.struct(date, *values).alias("r")).schema["r"].dataType).alias("__row"))
    right = rows.select(F.col(key), F.col(date).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(left.schema["__probe"].dataType).alias("__probe"), F.struct(date, *values).alias("__row"))
    w = Window.partitionBy(key).orderBy("__t", "__side", "__row").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right)
    if per_field:
        found = [F.last(F.col("__row")[v], ignorenulls=True).over(w).alias(v) for v in [date, *values]]
        return both.select("*", *found).where("__probe is not null").select("__probe.*", *[date, *values])
    return both.withColumn("__got", F.last("__row", ignorenulls=True).over(w)).where("__probe is not null").select("__probe.*", *[F.col("__got")[v].alias(v) for v in [date, *values]])


def kth_before(probes: DataFrame, rows: DataFrame, key: str, at: str, date: str, k: int) -> DataFrame:
    """The k-th last date strictly before ``at``: numbered rows, then one as-of join to the number."""
    numbered = rows.select(key, date).distinct().withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(date)))
    got = asof_join(probes, numbered, key, at, date, ["__i"], strict=True).drop(date)
    return got.withColumn("__i", F.col("__i") - (k - 1)).join(numbered, [key, "__i"], "left").drop("__i")


def _latest_holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key, day, intervals first. Of a key's intervals a stack is kept: each one begins later and ends earlier than the one below it, as one that ends no later than a
    newer one never wins again. A probe's winner is the top, once what has ended is taken off. The stack's rows go on to the next batch, after them the last row for its key."""
    kept, stack = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, first = pa.Table.from_batches([batch]), 0
        if kept is not None:
            rows, first = pa.concat_tables([kept, rows]), kept.num_rows
        new = np.append(True, ~like_before(rows["key"].combine_chunks()))[first:].tolist()
        probes, winners = [], []
        columns = (rows[c].slice(first).to_pylist() for c in ("side", "day", "upto"))
        for i, (begins, side, day, upto) in enumerate(zip(new, *columns, strict=True), first):
            if begins:
                stack = []
            until = day if side else upto
            while stack and stack[-1][1] <= until:
                stack.pop()
            if side:
                probes.append(i)
                winners.append(stack[-1][0] if stack else None)
            else:
                stack.append((i, upto))
        whole = rows.combine_chunks()
        at, won = pa.array(probes, pa.int64()), pa.array(winners, pa.int64())
        yield pa.RecordBatch.from_arrays([whole[c].combine_chunks().take(x) for c, x in (("key", at), ("probe", at), ("interval", won))], ["key", "probe", "interval"])
        kept = whole.take(pa.array([*(i for i, _ in stack), rows.num_rows - 1], pa.int64()))
        stack = [(i, upto) for i, (_, upto) in enumerate(stack)]


def interval_join(left: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """``left`` with the interval of its key that holds the day ``at`` (end inclusive, null open); of several the latest start wins (ties: the last by its other
    columns). No interval: nulls. Intervals may overlap and nest.

    One shuffle on the key and one sorted pass over its probes and intervals: each row goes through once, however many intervals hold a day. A task keeps those of
    one key that may still win, at most one for each day of end.
    """
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    rest = [start, *[c for c in intervals.columns if c not in (key, start)]]
    probe, row = F.struct(*[c for c in left.columns if c != key]), F.struct(*rest)
    asked = left.select(F.col(key).alias("key"), number(at).alias("day"), F.lit(1).alias("side"), F.lit(None).cast("int").alias("upto"), probe.alias("probe"))
    x = intervals.where(F.col(key).isNotNull() & F.col(start).isNotNull())
    x = x.select(F.col(key).alias("key"), number(start).alias("day"), F.lit(0).alias("side"), F.coalesce(number(end) + 1, F.lit(2**31 - 1)).alias("upto"), row.alias("interval")).where("upto > day")
    both = asked.unionByName(x, allowMissingColumns=True).repartition("key").sortWithinPartitions("key", "day", "side", "interval")
    got = both.mapInArrow(_latest_holding, both.select("key", "probe", "interval").schema)
    return got.select(*[F.col("key" if c == key else f"probe.`{c}`").alias(c) for c in left.columns], *[F.col("interval")[c].alias(c) for c in rest])


def rule_join(left: DataFrame, rules: DataFrame, on: list[str], at: str, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Rows with the rule version valid at their date, [start, end) with null open. Rule tables are constants of a few rows, broadcast."""
    r = rules.select(*[F.col(c).alias(f"__{c}") for c in rules.columns])
    cond: Column = (F.col(at) >= F.col(f"__{start}")) & (F.col(f"__{end}").isNull() | (F.col(at) < F.col(f"__{end}")))
    for c in on:
        cond = cond & (F.col(c) == F.col(f"__{c}"))
    extra = [F.col(f"__{c}").alias(c) for c in rules.columns if c not in (*on, start, end)]
    return left.join(F.broadcast(r), cond, "left").select(*left.columns, *extra)


def bitemporal(df: DataFrame, economic: str, system: str) -> DataFrame:
    """Rows visible at an economic and a system time."""
    e, s = F.lit(economic).cast("date"), F.lit(system).cast("date")
    return df.where((F.col("effective_date") <= e) & (F.col("available_at") <= e) & (F.col("system_from") <= s) & (F.col("system_to").isNull() | (F.col("system_to") > s)))
