"""Values of a daily series that only a month's last row needs: frames are walked at month ends, not at every row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows before the current one that a value looks back to.
BACK = 120
VALUES = ["mom", "rev", "vol", "dd", "ram", "trend"]


def like_before(a: pa.Array) -> np.ndarray:
    """Whether each item but the first equals the one before; two nulls are equal."""
    x, y = a[1:], a[:-1]
    return pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)


def _values(close: np.ndarray, at: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Of the rows ``at``, the n-th of their series: sums run from a frame's oldest row on, as Spark's do."""
    before = lambda j: np.where(n > j, close[np.maximum(at - j, 0)], np.nan)
    v = close[at]
    peak = np.full(len(at), np.nan)
    for j in range(BACK - 1, -1, -1):
        peak = np.fmax(peak, before(j))
    count, mean, m2 = np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at))
    total = {k: np.zeros(len(at)) for k in ("ret", 20, 60)}
    have = {k: np.zeros(len(at)) for k in (20, 60)}
    prev = before(60)
    for j in range(59, -1, -1):
        x = before(j)
        ret = np.where(prev > 0, x / prev - 1, np.nan)
        there = ~np.isnan(ret)
        count = count + there
        delta = np.where(there, ret - mean, 0.0)
        part = delta / np.maximum(count, 1)
        mean, m2, total["ret"] = mean + part, m2 + delta * (delta - part), total["ret"] + np.where(there, ret, 0.0)
        for k in (20, 60):
            if j < k:
                total[k], have[k] = total[k] + np.where(np.isnan(x), 0.0, x), have[k] + ~np.isnan(x)
        prev = x
    vol = np.where(count > 1, np.sqrt(m2 / np.maximum(count - 1, 1)), np.nan)
    ma20, ma60 = (np.where(n >= k, total[k] / np.where(have[k] > 0, have[k], np.nan), np.nan) for k in (20, 60))
    votes = np.stack([np.sign(v - ma20), np.sign(ma20 - ma60), np.sign(v - before(20))])
    cast = (~np.isnan(votes)).sum(axis=0)
    return {
        "close": v, "mom": v / before(120) - 1, "rev": -(v / before(5) - 1), "vol": vol, "dd": v / peak - 1,
        "ram": np.where((count >= 60) & (vol > 0), total["ret"] / 60 / np.where(vol > 0, vol, np.nan), np.nan),
        "trend": np.where((n >= 20) & (cast > 0), np.nansum(votes, axis=0) / np.maximum(cast, 1), np.nan),
    }


def _month_ends(batches, values):
    """Rows come by code and day. The last rows of a batch are kept for the next one: the last as its month may go on, those before for its frames."""
    kept, dropped = None, 0

    def found(table: pa.Table, first: int, upto: int, dropped: int):
        code, month = table["code"].combine_chunks(), table["month"].combine_chunks()
        same = like_before(code)
        rows = np.arange(len(code))
        begin = np.maximum.accumulate(np.where(np.append(False, same), 0, rows))
        n = rows - begin + 1 + np.where(begin == 0, dropped, 0)
        last = np.append(~(same & like_before(month)), True)
        at = first + np.flatnonzero(last[first:upto])
        with np.errstate(all="ignore"):
            got = _values(pc.fill_null(table["close"].combine_chunks(), np.nan).to_numpy(zero_copy_only=False), at, n[at])
        dated = pc.is_valid(month.take(pa.array(at))).to_numpy(zero_copy_only=False)
        columns = [pa.array(np.where(dated, got[c], np.nan), from_pandas=True) for c in values]
        return n, pa.RecordBatch.from_arrays([code.take(pa.array(at)), month.take(pa.array(at)), *columns], ["code", "month", *values])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        first = 0
        if kept is not None:
            table, first = pa.concat_tables([kept, table]), kept.num_rows - 1
        size = table.num_rows
        n, out = found(table, first, size - 1, dropped)
        yield out
        cut = max(0, size - BACK - 1)
        kept, dropped = table.slice(cut), int(n[cut]) - 1
    if kept is not None:
        yield found(kept, kept.num_rows - 1, kept.num_rows, dropped)[1]


def month_panel(df: DataFrame, values: Sequence[str] = VALUES) -> DataFrame:
    """Of (code, trade_date, close) at each code's last row of each month: mom (120 rows), rev (less the move over 5), vol (sample deviation of 60 returns), dd (against
    the highest of 120), ram (mean by deviation of 60 returns, all there) and trend (``series.trend_strength``); of ``values`` also close. A return needs a price above zero before it."""
    x = df.select("code", "trade_date", F.trunc("trade_date", "MM").alias("month"), F.col("close").cast("double").alias("close"))
    x = x.repartition("code").sortWithinPartitions("code", "trade_date").select("code", "month", "close")
    return x.mapInArrow(partial(_month_ends, values=values), f"code {dict(df.dtypes)['code']}, month date, " + ", ".join(f"{c} double" for c in values))
