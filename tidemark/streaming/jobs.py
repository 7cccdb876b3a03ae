"""Incremental jobs as Structured Streaming, run over all there is (availableNow) and merged into keyed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.series import folded
from tidemark.sources import lake as L


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of one table or folder, its NTZ times as timestamps (watermarks ask for them)."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema)
    df = reader.parquet(folder, pathGlobFilter=name) if _is_file(spark, path) else reader.parquet(path)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.simpleString() == "timestamp_ntz"})


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def run_to_table(df: DataFrame, root: str, mode: str = "complete", keys: list[str] | None = None, name: str = "job") -> DataFrame:
    """Run a stream over all there is into Parquet below ``root``/``name``.

    Checkpoint and output have fixed places, so a later call goes on where this one ended; each batch has a folder of its own that a retry of the
    batch replaces. In complete mode the last batch is the table, in append mode all batches are; in update mode each batch holds the rows that
    changed, and a row of ``keys`` is the one of its last batch, so that the state of windows older than the watermark can be dropped. With ``keys``
    an append-only stream is read in this way too.
    """
    spark, out = df.sparkSession, f"{root}/{name}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/{name}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], df.schema)
    got = spark.read.schema(f"{_ddl(df)}, batch int").parquet(out)
    if mode == "complete":
        return got.join(got.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")
    if keys:
        rest = [c for c in df.columns if c not in keys]
        return got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
    return got.drop("batch")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def in_turns(parts: list[DataFrame], folder: str, run: Callable[[], DataFrame]) -> DataFrame:
    """Add each part to a stream's folder and run the stream after each: what a job does that is started again whenever there is more to read."""
    out = None
    for part in parts:
        part.write.mode("append").parquet(folder)
        out = run()
    return out


def upsert_new(batches: DataFrame, root: str, key: str, order: str, name: str = "upsert") -> DataFrame:
    """A keyed table that grows by what a stream brings and it does not have: of each batch the first row (by ``order``) of each key unknown to
    earlier batches. A batch that runs again replaces what it added, and a row that comes again changes nothing."""
    spark, out = batches.sparkSession, f"{root}/{name}/out"
    schema = f"{_ddl(batches)}, batch int"

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != key]
        first = batch.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("row")).select(key, "row.*")
        if number:
            first = first.join(spark.read.schema(schema).parquet(out).where(F.col("batch") < number).select(key), key, "left_anti")
        first.select(*batch.columns).write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    q = batches.writeStream.option("checkpointLocation", f"{root}/{name}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out).drop("batch")


def split_late(df: DataFrame, root: str, time: str, delay: str, name: str = "revisions") -> DataFrame:
    """Append a stream to a table, with ``late``: whether a row lies behind the watermark of the batches before its own, the latest time they held less
    ``delay`` (an interval such as '30 days'). Late rows go to a folder of their own, so that they can be counted and read apart; none is dropped.

    Each batch leaves its latest time in one small file. A batch that runs again replaces its files and reads only those of earlier batches, so that
    it decides alike.
    """
    spark, base = df.sparkSession, f"{root}/{name}"

    def write(batch: DataFrame, number: int) -> None:
        top = batch.agg(F.max(time).alias("top")).write.mode("overwrite")
        seen = None
        if number:
            seen = spark.read.schema("top timestamp, batch int").parquet(f"{base}/tops").where(F.col("batch") < number).agg((F.max("top") - F.expr(f"interval {delay}")).alias("mark")).first().mark
        late = F.coalesce(F.col(time).cast("timestamp") < F.lit(seen).cast("timestamp"), F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{base}/out/batch={number:09d}")
        top.parquet(f"{base}/tops/batch={number:09d}")

    q = df.withColumn(time, F.col(time).cast("timestamp")).writeStream.option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(f"{_ddl(df.withColumn(time, F.col(time).cast('timestamp')))}, batch int, late boolean").parquet(f"{base}/out")


def freshness(df: DataFrame, policy: DataFrame, feed: str, time: str) -> DataFrame:
    """The latest time of each feed with its own limit, from a static table (feed, limit): a stream-static join, read anew with each batch."""
    return df.join(policy, feed).groupBy(feed, "limit").agg(F.max(time).alias("last_at"))


def dedup(df: DataFrame, key: list[str], time: str, watermark: str) -> DataFrame:
    """First row per key within the watermark."""
    return df.withWatermark(time, watermark).dropDuplicatesWithinWatermark(key)


def tumbling(df: DataFrame, time: str, by: str, value: str, size: str) -> DataFrame:
    g = df.withWatermark(time, "1 hour").groupBy(F.window(time, size), by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), by, "n", "mean")


def sliding(df: DataFrame, time: str, by: str, value: str, size: str, step: str) -> DataFrame:
    g = df.withWatermark(time, "1 hour").groupBy(F.window(time, size, step), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), by, "n", "total")


def sessions(df: DataFrame, time: str, by: str, gap: str) -> DataFrame:
    """Sessions of each key: start, end (``gap`` after its last event), n. An event at a session's end still belongs to it. Run it in append mode: a session is told, and its state dropped, once the watermark
    has passed its end."""
    g = df.withWatermark(time, "1 hour").groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def with_open_sessions(closed: DataFrame, rows: DataFrame, time: str, by: str, gap: str) -> DataFrame:
    """The sessions that a stream has told, and those that are still open, from the rows since the last told end of their key."""
    last = closed.groupBy(by).agg(F.max("end").alias("__end"))
    left = rows.join(last, by, "left").where(F.col("__end").isNull() | (F.col(time) >= F.col("__end")))
    still = left.groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return closed.unionByName(still.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n"))


def chain(df: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """Rows of an audit chain: each with the hash of the row before and its own, the digest of that hash and the payload. A chain is a fold, so one key's
    rows are one array; an audit log has a key per day or file."""
    own = f"sha2(concat(a.s.entry_hash, '|', coalesce(x.{payload}, '')), 256)"
    zero = "repeat('0', 64)"
    got = folded(df.select(key, order, payload), [payload], f"named_struct('previous_hash', {zero}, 'entry_hash', {zero})", f"named_struct('previous_hash', a.s.entry_hash, 'entry_hash', {own})", date=order, key=key)
    return df.join(got, [key, order])


def entry_hash(payload: str) -> Column:
    """The hash that a row of a chain should have by its own previous hash and payload."""
    return F.sha2(F.concat(F.col("previous_hash"), F.lit("|"), F.coalesce(F.col(payload).cast("string"), F.lit(""))), 256)


def first_break(df: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """First row per key whose own hash is not that of its previous hash and payload, or whose previous hash is not the hash of the row before it; keys
    without one are left out. A row that was changed and hashed again is found at the row after it."""
    before = F.coalesce(F.lag("entry_hash").over(Window.partitionBy(key).orderBy(order)), F.repeat(F.lit("0"), F.lit(64)))
    bad = ~F.col("entry_hash").eqNullSafe(entry_hash(payload)) | ~F.col("previous_hash").eqNullSafe(before)
    return df.withColumn("bad", bad).where("bad").groupBy(key).agg(F.min(order).alias("first_break"))


def conservation(deltas: DataFrame, balances: DataFrame, keys: list[str], day: str, tolerance: float = 1e-4) -> DataFrame:
    """Deltas (keys, day, delta) against stored balances (keys, day, balance), per account and bucket: the last balance less the first one must be the sum of
    the deltas after the first balance's day. A bucket without any balance or delta has nulls and is not conserved."""
    ends = balances.groupBy(*keys).agg(F.min(day).alias("since"), F.min_by("balance", day).alias("opening"), F.max_by("balance", day).alias("closing"))
    total = deltas.join(ends.select(*keys, "since"), keys).where(F.col(day) > F.col("since")).groupBy(*keys).agg(F.sum("delta").alias("total"))
    x = ends.join(total, keys, "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    error = F.col("closing") - F.col("opening") - F.col("total")
    return x.select(*keys, "opening", "closing", "total", error.alias("error"), F.coalesce(F.abs(error) <= tolerance, F.lit(False)).alias("ok"))


def reconcile(local: DataFrame, remote: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """Typed breaks between two books."""
    a, b = local.select(*key, F.col(value).alias("a")), remote.select(*key, F.col(value).alias("b"))
    kind = F.when(F.col("a").isNull(), "missing_local").when(F.col("b").isNull(), "missing_remote").when(F.abs(F.col("a") - F.col("b")) > tolerance, "difference")
    return a.join(b, key, "full").withColumn("kind", kind).where("kind is not null").select(*key, "kind")


#: Keys of more events than this are summed in chunks; others are one window, which needs no further shuffle.
LARGE = 100_000


def by_size(once: DataFrame, by: list[str]) -> list[tuple[DataFrame, bool]]:
    """The events of small keys, and those of large ones (True). Rows without a key are left out."""
    once = L.written(once.where(F.concat(*[F.col(c).cast("string") for c in by]).isNotNull()), "events_once")
    # At most a row per LARGE events.
    large = F.broadcast(L.written(once.groupBy(*by).count().where(F.col("count") > LARGE).select(*by), "large_keys"))
    return [(once.join(large, by, "left_anti"), False), (once.join(large, by, "left_semi"), True)]


def in_chunks(df: DataFrame, by: list[str], chunk: str, order: list[str], total: str, large: bool = True) -> tuple[DataFrame, Column, Column, Column]:
    """Running sums over keys that may hold a large part of all rows. Rows are summed within chunks (a key's month, say), and one row per chunk carries the sums
    on; where keys are not ``large``, a key is one chunk. Gives ``df`` with helper columns, and as columns of it the running sum, its smallest value so far
    (zero at most), and the smallest value before the row."""
    if not large:
        w = Window.partitionBy(*by).orderBy(*order)
        x = df.withColumn("__sum", F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        x = x.withColumn("__low", F.min("__sum").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__lower", F.min("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        return x, F.col("__sum"), F.least(F.lit(0.0), "__low"), F.least(F.lit(0.0), "__lower")
    inside = Window.partitionBy(*by, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = df.withColumn("__sum", F.sum(total).over(inside))
    x = x.withColumn("__low", F.min("__sum").over(inside)).withColumn("__lower", F.min("__sum").over(earlier))
    ends = x.groupBy(*by, chunk).agg(F.sum(total).alias("__all"), F.min("__low").alias("__least"))
    before = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__open", F.coalesce(F.sum("__all").over(before), F.lit(0.0)))
    ends = ends.withColumn("__floor", F.min(F.col("__open") + F.col("__least")).over(before)).drop("__all", "__least")
    joined = x.join(ends, [*by, chunk])
    low = lambda c: F.least(F.lit(0.0), "__floor", F.col("__open") + F.col(c))  # noqa: E731  nulls are left out
    return joined, F.col("__open") + F.col("__sum"), low("__low"), low("__lower")


CHUNKED = ("__sum", "__low", "__lower", "__open", "__floor")


def applied_once(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Each event id of a key once: the first one in order (ties: by the other columns)."""
    first = [*order, *[c for c in df.columns if c not in (*by, *order)]]
    return df.groupBy(*by, F.col("event_id").alias("__id")).agg(F.min(F.struct(*first)).alias("e")).select(*by, "e.*")


def positions_after(df: DataFrame, by: list[str], day: str, order: list[str], large: bool = True) -> DataFrame:
    """Each event with the quantity held after it, and before it. Sales beyond what is held are cut. (type, quantity, price.)

    Holdings between splits and rights are counted in today's units: a split of ratio r, and rights of r new units per unit held, multiply all that was
    held by a factor. In these units the holding is a sum held at zero from below: the free sum less its smallest value so far.
    """
    month = F.trunc(day, "MM").alias("__month")
    grow = F.when(F.col("type") == "split", F.log("quantity")).when(F.col("type") == "rights", F.log(1 + F.col("quantity"))).otherwise(0.0)
    x = df.select("*", month).withColumn("__grow", grow)
    x, grown, _, _ = in_chunks(x, by, "__month", order, "__grow", large)
    x = x.withColumn("__factor", F.exp(grown)).drop(*CHUNKED, "__grow")
    signed = F.when(F.col("type").isin("buy", "swap_in"), F.col("quantity")).when(F.col("type").isin("sell", "swap_out"), -F.col("quantity")).otherwise(0.0)
    x = x.withColumn("__units", signed / F.col("__factor"))
    x, free, low, lower = in_chunks(x, by, "__month", order, "__units", large)
    x = x.withColumn("__after", free - low).withColumn("__before", free - F.col("__units") - lower).drop(*CHUNKED, "__units")
    inverse = F.when(F.col("type") == "split", F.col("quantity")).when(F.col("type") == "rights", 1 + F.col("quantity")).otherwise(1.0)
    return x.withColumn("held", F.col("__after") * F.col("__factor")).withColumn("held_before", F.col("__before") * F.col("__factor") / inverse).drop("__after", "__before", "__factor", "__month")


def replay_ledger(df: DataFrame, by: list[str], order: list[str], opening: float, day: str = "day") -> DataFrame:
    """Cash, position, fees, receivable and net asset value of each account after all its events, each event id once. Events have event_id, type, quantity,
    price, fee and, for payments, ref:

    buy and sell (cut at what is held), dividend and tax (price per unit held), charge (price), record (a receivable of price per unit held) and pay (of the
    record ``ref``), split (quantity: new units for one), rights (quantity: new units per unit held, at price), swap_out and swap_in (units leave and come
    without cash). A type that is none of these changes nothing but counts. The position counts at the price last traded, after later splits.
    """
    if "ref" not in df.columns:
        df = df.withColumn("ref", F.lit(None).cast("string"))
    small, big = (_replayed(x, by, order, opening, day, large) for x, large in by_size(applied_once(df, by, order), by))
    return small.unionByName(big)


def _replayed(once: DataFrame, by: list[str], order: list[str], opening: float, day: str, large: bool) -> DataFrame:
    split = F.when(F.col("type") == "split", F.log("quantity")).otherwise(0.0)
    x, splits, _, _ = in_chunks(positions_after(once, by, day, order, large).withColumn("__split", split).withColumn("__month", F.trunc(day, "MM")), by, "__month", order, "__split", large)
    x = x.withColumn("__splits", splits)
    sold = F.col("held_before") - F.col("held")
    kind = lambda *k: F.col("type").isin(*k)
    cash = (
        F.when(kind("buy"), -F.col("quantity") * F.col("price") - F.col("fee")).when(kind("sell"), sold * F.col("price") - F.col("fee"))
        .when(kind("dividend"), F.col("held_before") * F.col("price")).when(kind("tax"), -F.col("held_before") * F.col("price")).when(kind("charge"), -F.col("price"))
        .when(kind("rights"), -F.col("held_before") * F.col("quantity") * F.col("price")).otherwise(0.0)
    )
    fees = F.when(kind("buy", "sell"), F.col("fee")).when(kind("charge"), F.col("price")).otherwise(0.0)
    # A receivable under its record's id: what the record is worth, and whether a payment names it later on.
    due = x.where(kind("record", "pay")).groupBy(*by, F.when(kind("record"), F.col("event_id")).otherwise(F.col("ref")).alias("__record")).agg(
        F.max(F.when(kind("record"), F.col("held_before") * F.col("price"))).alias("__amount"),
        F.coalesce(F.max(F.when(kind("pay"), F.struct(*order))) > F.max(F.when(kind("record"), F.struct(*order))), F.lit(False)).alias("__paid"),
    )
    amount = F.coalesce("__amount", F.lit(0.0))
    due = due.groupBy(*by).agg(F.sum(F.when(F.col("__paid"), amount).otherwise(0.0)).alias("__got"), F.sum(F.when(F.col("__paid"), 0.0).otherwise(amount)).alias("__due"))
    at = F.struct(*order)
    totals = x.groupBy(*by).agg(
        (F.lit(opening) + F.sum(cash)).alias("cash"), F.max_by("held", at).alias("held"), F.sum(fees).alias("fees"), F.count(F.lit(1)).alias("events"),
        F.max_by("__splits", at).alias("__last"), F.max_by(F.when(kind("buy", "sell"), F.struct("price", "__splits")), F.when(kind("buy", "sell"), at)).alias("__trade"),
    )
    got, due_left = F.coalesce("__got", F.lit(0.0)), F.coalesce("__due", F.lit(0.0))
    mark = F.coalesce(F.col("__trade.price") * F.exp(F.col("__trade.__splits") - F.col("__last")), F.lit(0.0))
    out = totals.join(due, by, "left").withColumn("cash", F.col("cash") + got)
    return out.select(*by, "cash", "held", "fees", "events", due_left.alias("receivable"), (F.col("cash") + F.col("held") * mark + due_left).alias("nav"))


def fifo_lots(df: DataFrame, by: list[str], order: list[str], day: str = "day") -> DataFrame:
    """First-in-first-out lots left after sales that may exceed what is held (the excess is dropped), with the next day as first sellable day;
    each event id counts once.

    What is held at the end lies in the last purchases: a lot keeps what of its interval of cumulative purchases lies above all purchases less the
    holding.
    """
    small, big = (_lots_left(x, by, order, day, large) for x, large in by_size(applied_once(df, by, order), by))
    return small.unionByName(big)


def _lots_left(df: DataFrame, by: list[str], order: list[str], day: str, large: bool) -> DataFrame:
    held = positions_after(df, by, day, order, large).groupBy(*by).agg(F.max_by("held", F.struct(*order)).alias("held"))
    bought = df.where("type = 'buy'").withColumn("__month", F.trunc(day, "MM"))
    rows, upto, _, _ = in_chunks(bought, by, "__month", order, "quantity", large)
    rows = rows.withColumn("upto", upto)
    total = bought.groupBy(*by).agg(F.sum("quantity").alias("all"))
    x = rows.join(total, by).join(held, by).withColumn("left", F.least("quantity", F.col("upto") - (F.col("all") - F.col("held"))))
    return x.where("left > 1e-9").select(*by, F.col(day).alias("acquired"), F.col("left").alias("quantity"), F.date_add(day, 1).alias("sellable"))


def members_at(df: DataFrame, group: str, code: str, date: str, at: str) -> DataFrame:
    """Codes whose last event up to a day is an add. (event_type, event_no) decide ties of one day."""
    g = df.where(F.col(date) <= at).groupBy(group, code).agg(F.max_by("event_type", F.struct(date, "event_no")).alias("last"))
    return g.where("last = 'add'").select(group, code)
