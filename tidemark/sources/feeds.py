"""News feeds: RSS, Atom and wrapped JSON documents into items, what cannot be read set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The feed's own layouts, as far as items are made of them. Items stand in a channel, or beside it in older feeds.
RSS = "struct<title:string,description:string,link:string,pubDate:string>"
ATOM = "struct<title:string,summary:string,published:string,updated:string,link:array<struct<_href:string>>>"
XML = f"channel struct<item:array<{RSS}>>, item array<{RSS}>, entry array<{ATOM}>, _corrupt_record string"
JSON = "result struct<data:array<struct<title:string,summary:string,intro:string,url:string,docurl:string,ctime:string>>>, _corrupt_record string"

#: Times that feeds give, after the day's name and before a missing zone is filled in. Fixed values.
TIMES = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss Z", "yyyy-MM-dd Z")


def feed_time(text: Column) -> Column:
    """A feed's time; without a zone it is universal time, of unknown form it is null."""
    t = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    t = F.regexp_replace(t, r"(T\d{2}:\d{2}:\d{2})\.\d+", "$1")
    zoned = t.rlike(r"(Z|[A-Z]{2,4}|[+-]\d{2}:?\d{2})$") & ~t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    full = F.when(zoned, t).when(t.contains("T"), F.concat(t, F.lit("Z"))).otherwise(F.concat(t, F.lit(" +0000")))
    return F.coalesce(*[F.try_to_timestamp(full, F.lit(p)) for p in TIMES])


def plain_text(html: Column) -> Column:
    """Text without tags, white space made single; null if nothing is left."""
    text = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), r"\s+", " "))
    return F.when(text != "", text)


def content_hash(source: Column, title: Column, url: Column) -> Column:
    """SHA-256 over source, title and address, a zero byte between them."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.sha2(F.concat(F.coalesce(source, F.lit("")), F.lit("\0"), text(title), F.lit("\0"), text(url)), 256)


def parsed(docs: DataFrame, body: str = "body") -> DataFrame:
    """``docs`` with ``__items`` (title, summary, url, published) and ``__bad``: why a document gives none."""
    text = F.trim(F.regexp_replace(F.coalesce(F.col(body), F.lit("")), "^﻿", ""))
    wrapped = text.startswith("(") | (~text.startswith("{") & text.contains("("))
    json = F.when(wrapped, F.regexp_extract(text, r"(?s)^[^(]*\((.*)\)[^)]*$", 1)).otherwise(text)
    is_xml = text.startswith("<")
    x = docs.withColumn("__xml", F.when(is_xml, F.from_xml(text, XML, {"mode": "PERMISSIVE", "ignoreNamespace": "true", "attributePrefix": "_"})))
    x = x.withColumn("__json", F.when(~is_xml & (text != ""), F.from_json(json, JSON, {"mode": "PERMISSIVE"})))
    none = F.array().cast("array<struct<title:string,summary:string,url:string,published:timestamp>>")
    item = lambda title, summary, url, at: F.struct(F.trim(title).alias("title"), plain_text(summary).alias("summary"), F.when(F.trim(url) != "", F.trim(url)).alias("url"), at.alias("published"))
    titled = lambda a: F.filter(a, lambda i: F.coalesce(i["title"], F.lit("")) != "")
    rss = F.concat(*[F.coalesce(F.col(c), F.array().cast(f"array<{RSS}>")) for c in ("__xml.channel.item", "__xml.item")])
    rss = titled(F.transform(rss, lambda i: item(i["title"], i["description"], i["link"], feed_time(i["pubDate"]))))
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1))
    href = lambda i: last(F.filter(F.transform(i["link"], lambda a: a["_href"]), lambda h: h.isNotNull()))
    atom = titled(F.transform("__xml.entry", lambda i: item(i["title"], i["summary"], href(i), feed_time(F.coalesce(i["published"], i["updated"])))))
    seconds = lambda c: F.timestamp_seconds(c.try_cast("bigint"))
    rows = titled(F.transform("__json.result.data", lambda i: item(i["title"], F.coalesce(i["summary"], i["intro"]), F.coalesce(i["url"], i["docurl"]), seconds(i["ctime"]))))
    broken = F.col("__xml._corrupt_record").isNotNull() | F.col("__json._corrupt_record").isNotNull()
    some = F.when(F.size(rss) > 0, rss).when(is_xml, atom).otherwise(rows)
    x = x.withColumn("__items", F.when(broken, none).otherwise(F.coalesce(some, none)))
    return x.withColumn("__bad", F.when(text == "", "empty").when(broken, "not readable").when(F.size("__items") == 0, "no items")).drop("__xml", "__json")


def feed_items(docs: DataFrame, source: str = "source", body: str = "body") -> DataFrame:
    """The items of feed documents: the columns of ``docs`` but the body, title, url, published_at, summary (tags stripped) and content_hash.

    A document is read once, whatever its layout; RSS items come before Atom entries. Items without a title are left out. Null, empty
    and unreadable documents give none (``unread_feeds`` tells of them).
    """
    keep = [c for c in docs.columns if c != body]
    x = parsed(docs, body).select(*keep, F.explode("__items").alias("i"))
    return x.select(*keep, F.col("i.title").alias("title"), F.col("i.url").alias("url"), F.col("i.published").alias("published_at"), F.col("i.summary").alias("summary"), content_hash(F.col(source), F.col("i.title"), F.col("i.url")).alias("content_hash"))


def unread_feeds(docs: DataFrame, body: str = "body") -> DataFrame:
    """The documents without items, and why."""
    return parsed(docs, body).where("__bad is not null").drop("__items").withColumnRenamed("__bad", "reason")


#: Places of a quote line's fields, from 0. Fixed values of the vendor's format.
QUOTE = {"name": 1, "code": 2, "close": 3, "previous": 4, "open": 5, "volume": 6, "observed_at": 30, "pct_change": 32, "high": 33, "low": 34, "amount": 37, "turnover": 38}


def quote_lines(texts: DataFrame, text: str) -> DataFrame:
    """Quotes of texts that hold lines such as ``v_x="a~b~..."``: name, code, prices, volume as given, amount times 10,000, turnover over 100, observed_at.

    Lines without a quoted part, with 38 fields or fewer, or with a time that is not one are left out; a number that is not one is null. Other columns
    of the texts come first, but for those named like a field.
    """
    rest = [c for c in texts.columns if c != text and c not in QUOTE]
    line = F.explode(F.split(F.col(text), "\r\n|[\n\r]"))
    x = texts.select(*rest, line.alias("__line")).select(*rest, F.split(F.regexp_extract("__line", '="(.*)"', 1), "~").alias("__f")).where("size(__f) > 38")
    f = {n: F.trim(F.col("__f")[i]) for n, i in QUOTE.items()}
    number = lambda c: c.try_cast("double")
    at = F.when(f["observed_at"].rlike("^[0-9]{14}$"), F.try_to_timestamp(f["observed_at"], F.lit("yyyyMMddHHmmss")))
    plain = [number(f[c]).alias(c) for c in ("close", "previous", "open", "high", "low", "volume", "pct_change")]
    x = x.select(*rest, f["code"].alias("code"), f["name"].alias("name"), *plain, (number(f["amount"]) * 10_000).alias("amount"), (number(f["turnover"]) / 100).alias("turnover"), at.alias("observed_at"))
    return x.where(F.col("observed_at").isNotNull())
