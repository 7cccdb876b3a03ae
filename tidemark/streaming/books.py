"""Books kept by keyed state: ledgers, lots and scores that go on from batch to batch and from run to run.

A call to the state costs more than the fold of a key's few rows. So keys share ``BUCKETS`` buckets: the books of a bucket's keys are one
value, which a batch reads and writes once if it has rows of them; of long queues of lots only both ends are in it. Rows of a key and
batch are sorted; later batches are taken to be later in order, as in an event log that is read as it grows. The batch operators in
``jobs`` give the same results over a whole log at once, also where one key holds a large part of it.
"""

from __future__ import annotations

import datetime as dt
import pickle
from collections import defaultdict, deque
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Maps and timers in state ask for this store; it keeps state on the executors' disks and its changes in the checkpoint."""
    spark.conf.set(PROVIDER, ROCKS)


#: Keys of a stream share so many pieces of state. A checkpoint is bound to it.
BUCKETS = 4096


def _kept(df: DataFrame, by: list[str], books: StatefulProcessor, told: str, clock: str = "none") -> DataFrame:
    """Rows kept by a processor of books. Keys go through it as text, so that nulls and types stay."""
    keyed = df.withColumn("key_text", F.to_json(F.struct(*by))).withColumn("key_bucket", F.pmod(F.xxhash64(*by), F.lit(BUCKETS)).cast("int"))
    got = keyed.drop(*by).groupBy("key_bucket").transformWithStateInPandas(books, f"key_text string, {told}", "append", clock)
    key = F.from_json("key_text", _by_ddl(df, by))
    return got.select(*[key[c].alias(c) for c in by], *[c for c in got.columns if c != "key_text"])


class Books(StatefulProcessor):
    """The books of a bucket's keys, by key. ``fold`` takes a book (None: a new key) and the key's sorted rows; it gives the book and the rows to tell."""

    def __init__(self, order: list[str], told: list[str]):
        self.order, self.told = order, told

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.books = handle.getValueState("books", "data binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        books = pickle.loads(self.books.get()[0]) if self.books.exists() else {}
        groups, out, place = defaultdict(list), [], attrgetter(*self.order)
        for part in rows:
            for r in part.itertuples(index=False):
                groups[r.key_text].append(r)
        for k, of_key in groups.items():
            books[k], told = self.fold(k, books.get(k), sorted(of_key, key=place))
            out += [(k, *row) for row in told]
        self.books.update((pickle.dumps(books, protocol=5),))
        yield pd.DataFrame(out, columns=["key_text", *self.told])

    def close(self) -> None:
        pass


class Ledger(Books):
    """Cash, fees, positions and receivables of accounts."""

    def __init__(self, order: list[str], opening: float, limited: bool):
        super().__init__(order, ["cash", "held", "fees", "events", "receivable", "nav"])
        self.opening, self.limited = opening, limited

    def fold(self, key: str, book: tuple | None, rows: list) -> tuple[tuple, list[tuple]]:
        cash, fees, events, held, due, value, positions, receivables = book or (self.opening, 0.0, 0, 0.0, 0.0, 0.0, {}, {})
        touched: dict[str, list[float]] = {}

        def position(code: str) -> list[float]:
            nonlocal held, value
            if code not in touched:
                touched[code] = positions.setdefault(code, [0.0, 0.0])
                held, value = held - touched[code][0], value - touched[code][0] * touched[code][1]
            return touched[code]

        for e in rows:
            p = position(e.code)
            events += 1
            match e.type:
                case "buy":
                    cash, fees = cash - e.quantity * e.price - e.fee, fees + e.fee
                    p[:] = p[0] + e.quantity, e.price
                case "sell":
                    sold = min(p[0], e.quantity)
                    cash, fees = cash + sold * e.price - e.fee, fees + e.fee
                    p[:] = p[0] - sold, e.price
                case "dividend":
                    cash += p[0] * e.price
                case "tax":
                    cash -= p[0] * e.price
                case "charge":
                    cash, fees = cash - e.price, fees + e.price
                case "record":
                    receivables[e.event_id] = p[0] * e.price
                    due += p[0] * e.price
                case "pay":
                    amount = receivables.pop(e.ref, 0.0)
                    cash, due = cash + amount, due - amount
                case "split":
                    p[:] = p[0] * e.quantity, p[1] / e.quantity
                case "rights":
                    cost = p[0] * e.quantity * e.price
                    if not self.limited or cost <= cash:
                        cash, p[0] = cash - cost, p[0] * (1 + e.quantity)
                case "swap_in":
                    p[0] += e.quantity
                case "swap_out":
                    p[0] -= min(p[0], e.quantity)
                case "swap":
                    other = position(e.ref)
                    other[:] = other[0] + p[0] * e.quantity, p[1] / e.quantity
                    p[:] = 0.0, 0.0
        for quantity, mark in touched.values():
            held, value = held + quantity, value + quantity * mark
        return (cash, fees, events, held, due, value, positions, receivables), [(cash, held, fees, events, due, cash + value + due)]


#: What an order's event makes of its status, and the statuses that only another such one follows. Fixed values.
ORDER_STATUS = {
    "submitted": "submitted", "acknowledged": "accepted", "rejected": "rejected", "partially_filled": "partially_filled", "filled": "filled", "cancel_requested": "cancel_pending",
    "cancelled": "cancelled", "cancel_rejected": "accepted", "expired": "expired", "fill_cancelled": "accepted", "fill_corrected": "filled",
}
TERMINAL = ["rejected", "filled", "cancelled", "expired"]


class OrderState(Books):
    """The status of orders: the event that is last by (terminal, place), kept with its place, so that events may come in any order."""

    def __init__(self):
        super().__init__(["terminal", "place", "sequence"], ["status", "events"])

    def fold(self, key: str, book: tuple | None, rows: list) -> tuple[tuple, list[tuple]]:
        best, status, events = book or ((False, -1, -1), "created", 0)
        events += len(rows)
        for e in rows:
            new = (e.terminal, e.place, e.sequence)
            if e.status is not None and new >= best:
                best, status = new, e.status
        return (best, status, events), [(status, events)]


def order_events(df: DataFrame) -> DataFrame:
    """Events (event_type, broker_sequence, sequence, ...) with status (null where the type says nothing of it), terminal and place: the broker's number, or behind all of
    those the own one."""
    known = F.create_map(*[F.lit(x) for pair in ORDER_STATUS.items() for x in pair])
    status = F.try_element_at(known, F.col("event_type"))
    return df.withColumns({"status": status, "terminal": F.coalesce(status.isin(TERMINAL), F.lit(False)), "place": F.coalesce(F.col("broker_sequence"), F.col("sequence") + 10**12).cast("long")})


def order_stream(df: DataFrame, by: list[str], once: list[str]) -> DataFrame:
    """The status of each order and its number of events, a row whenever a batch brings some. An event comes once by its external id (``once``)."""
    x = order_events(df.dropDuplicates(once)).select(*by, "status", "terminal", "place", F.coalesce(F.col("sequence").cast("long"), F.lit(-1)).alias("sequence"))
    return _kept(x, by, OrderState(), "status string, events long")


def order_states(df: DataFrame, by: list[str], once: list[str]) -> DataFrame:
    """``order_stream`` of a whole log at once, by one aggregate."""
    x = order_events(df.dropDuplicates(once))
    rank = F.struct("terminal", "place", "sequence")
    last = F.max_by("status", F.when(F.col("status").isNotNull(), rank))
    return x.groupBy(*by).agg(F.coalesce(last, F.lit("created")).alias("status"), F.count(F.lit(1)).alias("events"))


def _by_ddl(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)


def ledger_stream(df: DataFrame, by: list[str], order: list[str], opening: float, limited: bool = False) -> DataFrame:
    """A stream of events folded per account ``by``: after each batch, for each account in it, cash, held (units of all codes), fees, events,
    receivable and nav (cash, positions at their last traded price, and receivables). Run it into a table keyed by ``by``.

    Events have event_id, code, type, quantity, price, fee and ref; each event id of an account counts once, whichever batch it comes
    with again. Types as in ``jobs.replay_ledger``; besides, swap turns all of ``code`` into ``ref`` at the ratio ``quantity``, and with
    ``limited`` rights are taken only if the cash is there.
    """
    once = df.dropDuplicates([*by, "event_id"])
    return _kept(once, by, Ledger(order, opening, limited), "cash double, held double, fees double, events long, receivable double, nav double")


#: Lots of a key that its book holds at either end of the queue; those between are in pages of so many.
PAGE = 10_000


class Lots(Books):
    """First-in-first-out lots, numbered from the oldest: a queue, of which the middle is in pages if it is long."""

    def __init__(self, order: list[str], day: str, settled: bool):
        super().__init__(order, ["lot", "acquired", "quantity", "sellable"])
        self.day, self.settled, self.page = day, settled, PAGE

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pages = handle.getMapState("pages", "owner string, page long", "data binary")

    def fold(self, key: str, book: tuple | None, rows: list) -> tuple[tuple, list[tuple]]:
        after, low, high, front, back = book or (0, 0, 0, deque(), deque())
        changed: dict[int, list] = {}
        for e in rows:
            if e.type == "buy":
                changed[after] = [after, getattr(e, self.day), e.quantity]
                back.append(changed[after])
                after += 1
                if len(back) >= self.page:
                    self.pages.updateValue((key, high), (pickle.dumps(back, protocol=5),))
                    high, back = high + 1, deque()
            left = e.quantity if e.type == "sell" else 0.0
            while left > 0:
                if not front and low < high:
                    front = pickle.loads(self.pages.getValue((key, low))[0])
                    self.pages.removeKey((key, low))
                    low += 1
                elif not front:
                    front, back = back, front
                if not front or (self.settled and front[0][1] >= getattr(e, self.day)):
                    break
                x = changed[front[0][0]] = front[0]
                take = min(x[2], left)
                x[2], left = x[2] - take, left - take
                if x[2] > 1e-9:
                    break
                x[2] = 0.0
                front.popleft()
        told = [(n, day, quantity, day + dt.timedelta(days=1)) for n, day, quantity in changed.values()]
        return (after, low, high, front, back), told


def lots_stream(df: DataFrame, by: list[str], order: list[str], day: str = "day", settled: bool = False) -> DataFrame:
    """A stream of purchases and sales folded into lots: after each batch the lots that it opened or changed (``lot`` numbers them within a key; a
    quantity of 0 closes one). Run it into a table keyed by ``by`` and lot. Sales take the oldest lots first; with ``settled`` only lots
    of earlier days. What a sale asks beyond that is dropped. Each event id of a key counts once."""
    once = df.where("type in ('buy', 'sell')").dropDuplicates([*by, "event_id"])
    return _kept(once, by, Lots(order, day, settled), "lot long, acquired date, quantity double, sellable date")


DAY_MS = 86_400_000
DAY_US = 1000 * DAY_MS


def half_life(horizon: np.ndarray) -> np.ndarray:
    """Days after which half of a score is left: half the horizon, but no fewer than two."""
    return np.maximum(2.0, horizon / 2)


def _summed(entries: pd.DataFrame) -> pd.DataFrame:
    """One entry per key, day and horizon."""
    number = entries.groupby(["key_text", "day", "horizon"], sort=False).ngroup().to_numpy()
    first = entries.iloc[np.unique(number, return_index=True)[1]]
    return first.assign(total=np.bincount(number, entries["total"]), events=np.bincount(number, entries["events"]).astype("int64"))


class DecayedScores(StatefulProcessor):
    """The unexpired events of a bucket's keys, summed by key, day and horizon; a timer at the end of days tells the scores and drops what has expired.

    Events of one key, day and horizon decay alike and expire at the same step, so that one sum stands for them: a key holds at most one
    entry per day of each horizon, however many events it has. All keys are told up to the same step, that of the watermark, so that a
    bucket needs one timer.
    """

    def __init__(self, time: str, score: str, horizon: str):
        self.time, self.score, self.horizon = time, score, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "next long, data binary")

    def _held(self) -> tuple[int, pd.DataFrame]:
        step, data = self.open.get()
        return step, pickle.loads(data)

    def _hold(self, step: int, entries: pd.DataFrame) -> None:
        self.open.update((int(step), pickle.dumps(entries, protocol=5)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        step, entries = self._held() if self.open.exists() else (None, None)
        first = step
        for part in rows:
            day, rest = np.divmod(part[self.time].to_numpy(), DAY_US)
            horizon = part[self.horizon].to_numpy()
            # As if all stood at the day's beginning.
            total = part[self.score].to_numpy() * np.power(2.0, rest / DAY_US / half_life(horizon))
            added = pd.DataFrame({"key_text": part["key_text"].to_numpy(), "day": day, "horizon": horizon, "total": total, "events": 1})
            entries = _summed(added if entries is None else pd.concat([entries, added], ignore_index=True))
            first = min(int(day.min()) + 1, first or int(day.min()) + 1)
        if first != step:
            if step is not None:
                self.handle.deleteTimer(step * DAY_MS)
            self.handle.registerTimer(first * DAY_MS)
        self._hold(first, entries)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        (step, entries), upto = self._held(), timerValues.getCurrentWatermarkInMs() // DAY_MS
        number, names = pd.factorize(entries["key_text"])
        day, horizon, total, events = (entries[c].to_numpy() for c in ("day", "horizon", "total", "events"))
        until, told, n = day + horizon, [], 0
        while step <= upto and (until >= step).any():
            now = np.flatnonzero((day < step) & (until >= step))
            if not len(now):
                step = int(day[until >= step].min()) + 1
                continue
            score = np.bincount(number[now], total[now] * np.power(0.5, (step - day[now]) / half_life(horizon[now])), len(names))
            count = np.bincount(number[now], events[now], len(names))
            at = np.flatnonzero(count)
            told.append(pd.DataFrame({"key_text": names.to_numpy()[at], "step": dt.date(1970, 1, 1) + dt.timedelta(days=step), "score": score[at], "events": count[at].astype("int64")}))
            step, n = step + 1, n + len(at)
            if n >= 10_000:
                yield pd.concat(told)
                told, n = [], 0
        if told:
            yield pd.concat(told)
        if (until >= step).any():
            self._hold(step, entries[until >= step])
            self.handle.registerTimer(step * DAY_MS)
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def decayed_scores(df: DataFrame, by: list[str], time: str, score: str, horizon: str, delay: str) -> DataFrame:
    """Score and number of the unexpired events of each key at the end of each day up to the watermark: an event counts from its day's end on, half
    of it is left after its half-life, and ``horizon`` days after it happened it is gone. Days without such events give no row. Events without a time or a
    horizon are left out; without a score they count, but add nothing."""
    x = df.withWatermark(time, delay).where(F.col(time).isNotNull() & F.col(horizon).isNotNull())
    x = x.select(*by, time, horizon, F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias(score), F.unix_micros(time).alias("at_us"))
    return _kept(x, by, DecayedScores("at_us", score, horizon), "step date, score double, events long", "eventTime")
