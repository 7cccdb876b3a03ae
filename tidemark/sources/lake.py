"""Sources and sinks: versioned, year-partitioned Parquet, keyed merges, manifests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one (spark.checkpoint.dir), or a local one where that is unset in local mode, as in tests. Elsewhere it has to
    be set: machines do not share local folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-tidemark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to a new folder and read back: cuts lineage, and no part is computed twice."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SNAPSHOT = ["effective_date", "available_at", "ingested_at", "source", "row_hash"]


def row_hash(columns: list[str]) -> Column:
    """SHA-1 over the values as text joined by |; null and NaN are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.sha1(F.concat_ws("|", *[F.when(text(c) == "NaN", "").otherwise(text(c)) for c in columns]))


def with_snapshot(df: DataFrame, business: list[str], source: str, now: str) -> DataFrame:
    """Attach the snapshot columns; available_at defaults to ingested_at, that to ``now``."""
    have = set(df.columns)
    stamp = F.lit(now).cast("timestamp")
    ingested = F.coalesce(F.col("ingested_at"), stamp) if "ingested_at" in have else stamp
    df = df.withColumn("ingested_at", ingested)
    available = F.coalesce(F.col("available_at"), F.col("ingested_at")) if "available_at" in have else F.col("ingested_at")
    return df.withColumn("available_at", available).withColumn("source", F.lit(source)).withColumn("row_hash", row_hash(business))


def read_years(spark: SparkSession, root: str) -> DataFrame:
    """All year partitions, columns unioned by name, the partition column hidden."""
    return spark.read.option("mergeSchema", True).parquet(root).drop("year")


def write_years(df: DataFrame, root: str, date: str = "effective_date") -> None:
    """One directory per effective year; only the years of the batch are replaced."""
    df.withColumn("year", F.year(date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year").parquet(root)


def with_year_bounds(df: DataFrame, start: str, end: str, date: str = "effective_date") -> DataFrame:
    """A date range with the year bounds it implies, so that partitions are pruned."""
    return df.where(F.col("year").between(int(start[:4]), int(end[:4])) & F.col(date).between(start, end))


def versioned_view(table: DataFrame, lake: DataFrame, keys: list[str]) -> DataFrame:
    """Table rows and those lake rows whose key is not in the table (null-safe)."""
    t = table.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return table.unionByName(lake.join(t, cond, "left_anti"), allowMissingColumns=True)


def versioned_append(stored: DataFrame, batch: DataFrame, keys: list[str], marker: str = "row_hash") -> DataFrame:
    """Stored rows without those that have a key and ``marker`` of the batch, and the batch. With the row hash a retry replaces itself
    and changed content stays as a new revision; with the source a source's rows are replaced."""
    return stored.join(batch.select(*keys, marker).distinct(), [*keys, marker], "left_anti").unionByName(batch)


def merge_by_priority(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The rows of the first part that has the key."""
    both = None
    for i, p in enumerate(parts):
        x = p.withColumn("__p", F.lit(i))
        both = x if both is None else both.unionByName(x, allowMissingColumns=True)
    return both.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("__p"))).where("__k = 1").drop("__p", "__k")


def dedupe_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def coverage(df: DataFrame, codes: DataFrame, code: str, date: str) -> DataFrame:
    """(first, last, rows) of every wanted code; without rows null, null, 0."""
    g = df.groupBy(code).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count(F.lit(1)).alias("n"))
    return codes.join(g, code, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _below(path: Column, root: str) -> Column:
    """A file's path below ``root``: names alone repeat in other folders."""
    return F.substring_index(path, "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)


def file_manifest(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """file, bytes, modified, sha256 and n_rows of each Parquet file below ``path``.

    With a ``known`` manifest only files that are new or of another size or time are read; the others keep their entry. A file is hashed as one
    row, so files are bounded to 2 GB, as a writer's are.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("path").endswith(".parquet"))
    now = listed.select("path", _below(F.col("path"), path).alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    if known is not None:
        same = known.select("file", "bytes", "modified")
        kept = known.join(now.select("file", "bytes", "modified"), ["file", "bytes", "modified"], "left_semi")
        paths = [r.path for r in now.join(same, ["file", "bytes", "modified"], "left_anti").select("path").collect()]
        if not paths:
            return kept
        return kept.unionByName(_read_files(spark, path, paths))
    return _read_files(spark, path, [path])


def _read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).where(F.col("path").endswith(".parquet"))
    hashed = read.select(_below(F.col("path"), root).alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    rows = spark.read.option("recursiveFileLookup", True).parquet(*paths).groupBy(_below(F.col("_metadata.file_path"), root).alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
    return hashed.join(rows, "file", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_file(spark: SparkSession, path: str) -> bytes:
    """The bytes of one small file."""
    p, fs = _file(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def replace_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Other bytes in a small file's place."""
    p, fs = _file(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def verify_manifest(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """verified, missing, size_mismatch or hash_mismatch for each expected file."""
    o = observed.select("file", F.col("bytes").alias("ob"), F.col("sha256").alias("oh"))
    status = F.when(F.col("oh").isNull(), "missing").when(F.col("ob") != F.col("bytes"), "size_mismatch").when(F.col("oh") != F.col("sha256"), "hash_mismatch").otherwise("verified")
    return expected.join(o, "file", "left").select("file", status.alias("status"))


def file_lineage(df: DataFrame, root: str) -> DataFrame:
    """Rows with the path below ``root`` of the file they came from."""
    return df.select("*", _below(F.col("_metadata.file_path"), root).alias("source_file"))


def first_number(payload: str, keys: list[str]) -> Column:
    """First numeric value among candidate keys of a JSON text."""
    return F.coalesce(*[F.expr(f"try_cast(get_json_object({payload}, '$.{k}') as double)") for k in keys])


def any_date(text: str) -> Column:
    """YYYYMMDD or ISO text to a date; bad text gives null."""
    return F.coalesce(F.expr(f"try_to_date(substr({text}, 1, 8), 'yyyyMMdd')"), F.expr(f"try_to_date(substr({text}, 1, 10), 'yyyy-MM-dd')"))


def overlay(df: DataFrame, corrections: DataFrame, key: str, field: str) -> DataFrame:
    """Readers see the newest correction per record; the original stays. ``corrections`` has key, corrected, seq."""
    c = dedupe_latest(corrections, [key], [F.desc("seq")]).select(key, F.col("corrected").alias("__c"))
    return df.join(c, key, "left").withColumn(field, F.coalesce("__c", field)).drop("__c")


def scd_append(history: DataFrame, today: DataFrame, key: str, content: list[str], date: str) -> DataFrame:
    """Only those of today's records whose content differs from the newest stored one."""
    last = dedupe_latest(history, [key], [F.desc(date)]).select(key, row_hash(content).alias("__h"))
    return today.join(last, key, "left").where(F.col("__h").isNull() | (row_hash(content) != F.col("__h"))).drop("__h")


def canonical(records: DataFrame, seen: DataFrame, key: str, dataset: str, date: str) -> DataFrame:
    """Records whose key is not in ``seen``, with the hash of their payload and the number of those of their dataset that were left out for want of a date."""
    new = records.join(seen.select(key).distinct(), key, "left_anti")
    invalid = new.groupBy(dataset).agg(F.count_if(F.col(date).isNull()).alias("invalid"))
    return new.where(F.col(date).isNotNull()).join(invalid, dataset).select(*records.columns, F.sha2("payload", 256).alias("source_hash"), "invalid")


def with_lineage(rows: DataFrame, manifest: DataFrame, dates: list[str]) -> DataFrame:
    """Rows with source_file joined to its manifest entry: sha256, n_rows, ingested_at, and available_date, the first of ``dates`` there is, else the day the
    file came."""
    m = manifest.select(F.col("file").alias("source_file"), "sha256", "n_rows", F.col("modified").alias("ingested_at"))
    return rows.join(m, "source_file").withColumn("available_date", F.coalesce(*dates, F.to_date("ingested_at")))


def flag_active(rows: DataFrame, live: DataFrame, key: str, clear: bool = True) -> DataFrame:
    """``rows`` with ``active`` set where the key is in today's list, and cleared elsewhere if asked for. An empty list is taken for a failed fetch and changes nothing."""
    some = live.select(F.lit(True).alias("__some")).limit(1)
    on = live.select(key, F.lit(True).alias("__on")).distinct()
    flag = F.when(F.col("__some").isNull(), F.col("active")).when(F.col("__on"), F.lit(True)).otherwise(F.lit(False) if clear else F.col("active"))
    return rows.join(on, key, "left").join(F.broadcast(some), F.lit(True), "left").withColumn("active", flag).drop("__on", "__some")


def absent(tracked: DataFrame, quotes: DataFrame, key: str) -> DataFrame:
    """Tracked keys without a quote. Without any quote at all that would be all of them, so it is an error."""
    if quotes.isEmpty():
        raise ValueError("the snapshot has no quotes")
    return tracked.join(quotes.select(key), key, "left_anti")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: file, line (from 1), value. Each block of a file counts its own lines and adds those of the blocks before it, so
    that a file may be of any size."""
    x = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"), "value")
    x = x.withColumn("__i", F.row_number().over(Window.partitionBy("file", "__b").orderBy("__m")))
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    blocks = x.groupBy("file", "__b").agg(F.count(F.lit(1)).alias("__n")).select("file", "__b", F.coalesce(before, F.lit(0)).alias("__k"))
    return x.join(blocks, ["file", "__b"]).select("file", (F.col("__i") + F.col("__k")).alias("line"), "value")


def membership_csv(spark: SparkSession, path: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Add and remove events of CSV files with a header: (events, problems).

    The files need the columns index_code, stock_code, event_type and effective_date, in one order; stock_name and available_at may be there too. Texts are
    trimmed, types in small letters, codes filled with zeros up to six. A line without an index, a known type or a day is a problem (file, line, reason);
    one whose available_at is no time loses it only, which is a problem too. Of repeated events the first line stays, and those in ``known`` are left out.
    """
    names = [c.strip("﻿ \t").lower() for c in spark.read.option("header", True).csv(path).columns]
    need = ["index_code", "stock_code", "event_type", "effective_date"]
    if missing := sorted(set(need) - set(names)):
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    lines = numbered_lines(spark, path).where((F.col("line") > 1) & (F.trim("value") != ""))
    x = lines.select("file", "line", F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"mode": "PERMISSIVE"}).alias("r"))
    r = lambda c: F.trim(F.col(f"r.{c}")) if c in names else F.lit(None).cast("string")
    x = x.select(
        "file", "line", r("index_code").alias("index_code"), F.when(F.length(r("stock_code")) < 6, F.lpad(r("stock_code"), 6, "0")).otherwise(r("stock_code")).alias("stock_code"),
        F.lower(r("event_type")).alias("event_type"), r("effective_date").alias("__d"), F.nullif(r("stock_name"), F.lit("")).alias("stock_name"), F.nullif(r("available_at"), F.lit("")).alias("__a"),
    )
    x = x.withColumns({"effective_date": any_date("__d"), "available_at": F.expr("try_cast(__a as timestamp_ntz)")})
    good = F.coalesce((F.col("index_code") != "") & F.col("event_type").isin("add", "remove") & F.col("effective_date").isNotNull(), F.lit(False))
    reason = F.when(~good, "not valid").when(F.col("__a").isNotNull() & F.col("available_at").isNull(), "time not readable")
    x = x.withColumn("reason", reason)
    key = ["index_code", "stock_code", "effective_date", "event_type"]
    events = dedupe_latest(x.where(good), key, [F.asc("file"), F.asc("line")]).select(*key, "stock_name", "available_at")
    if known is not None:
        events = events.join(known.select(*key), key, "left_anti")
    return events, x.where("reason is not null").select("file", "line", "reason")


def market_close(snapshot: DataFrame, master: DataFrame, day: str, bars: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Closing quotes (code, ``day``, quote_date, close, volume, amount, ...) as bars of their day: (bars, rejects).

    Only codes of ``master`` are looked at. Quotes of another day and such without a price above zero are rejected (code, day, reason). The volume is in shares or
    in lots of 100, whichever times the price comes nearer to the amount (shares, if both do); without an amount it is taken as lots. With ``bars`` the new rows
    take the place of those of their code and day, and the others stay.
    """
    x = snapshot.join(master.select("code").distinct(), "code", "left_semi")
    reason = F.when(~F.col("quote_date").eqNullSafe(F.col(day)), "other day").when(F.coalesce("close", F.lit(0.0)) <= 0, "no price")
    x = x.withColumn("reason", reason)
    off = lambda scale: F.abs(F.col("amount") - F.col("volume") * scale * F.col("close"))
    scale = F.when((F.col("volume") > 0) & (F.col("amount") > 0) & (off(1) <= off(100)), 1).otherwise(100)
    new = x.where("reason is null").select("code", day, "close", (F.col("volume") * scale).alias("volume"), "amount", F.when(scale == 1, "share").otherwise("lot").alias("unit"))
    rejects = x.where("reason is not null").select("code", day, "reason")
    return (new if bars is None else merge_by_priority([new, bars], ["code", day])), rejects


def execution_limits(raw: DataFrame, derived: DataFrame, suspensions: DataFrame) -> DataFrame:
    """Price limits (code, trade_date, up_limit, down_limit) of each day: the raw row where there is one, else the derived one, as ``origin``; days of the suspensions
    (code, trade_date, kind S) are flagged, also those that have no limits."""
    limits = merge_by_priority([raw.withColumn("origin", F.lit("raw")), derived.withColumn("origin", F.lit("derived"))], ["code", "trade_date"])
    off = suspensions.where(F.upper(F.trim("kind")) == "S").select("code", "trade_date").distinct().withColumn("__s", F.lit(True))
    return limits.join(off, ["code", "trade_date"], "full").withColumn("suspended", F.col("__s").isNotNull()).drop("__s")
