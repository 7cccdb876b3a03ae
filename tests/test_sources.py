"""Feeds of all layouts, a relational database, keywords in texts."""

import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from tidemark.operators import keywords, portfolio
from tidemark.sources import feeds, lake


def test_feed_layouts(spark):
    rss = """<?xml version="1.0"?><rss><channel><title>all</title>
      <item><title> One </title><link> http://a/1 </link><description>&lt;p&gt;Some  &lt;b&gt;bold&lt;/b&gt;
 text&lt;/p&gt;</description><pubDate>Wed, 03 Jan 2024 08:00:00 +0800</pubDate></item>
      <item><title></title><link>http://a/2</link></item>
      <item><title><![CDATA[Three & more]]></title><pubDate>Wed, 3 Jan 2024 00:30:00 GMT</pubDate></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Four</title><link href="http://a/4"/><link rel="x" href="http://a/44"/><updated>2024-01-03T00:00:00.250Z</updated><summary>&lt;br/&gt;</summary></entry>
      <entry><title>Five</title><published>2024-01-03T02:00:00+02:00</published><updated>2030-01-01</updated></entry></feed>"""
    json = 'cb({"result": {"data": [{"title": "Six (6)", "intro": "x", "docurl": "u", "ctime": "1704240000"}, {"title": "Seven", "summary": "s", "intro": "i", "url": "v", "ctime": "soon"}, {"title": " "}]}});'
    rows = [("a", rss), ("b", atom), ("c", json), ("d", rss[:-30]), ("e", '{"result": {'), ("f", None), ("g", "<rss><channel></channel></rss>"), ("h", json[3:-2]), (None, rss)]
    docs = spark.createDataFrame(rows, "source string, body string")
    got = {(r.source, r.title): r for r in feeds.feed_items(docs).collect()}
    new = dt.datetime(2024, 1, 3)
    assert set(got) == {("a", "One"), ("a", "Three & more"), ("b", "Four"), ("b", "Five"), ("c", "Six (6)"), ("c", "Seven"), ("h", "Six (6)"), ("h", "Seven"), (None, "One"), (None, "Three & more")}
    one, three, four, five, six, seven = (got[k] for k in [("a", "One"), ("a", "Three & more"), ("b", "Four"), ("b", "Five"), ("c", "Six (6)"), ("c", "Seven")])
    assert (one.url, one.summary, one.published_at) == ("http://a/1", "Some bold text", new) and one.content_hash == hashlib.sha256(b"a\0One\0http://a/1").hexdigest()
    assert (three.url, three.summary, three.published_at) == (None, None, new + dt.timedelta(minutes=30))
    assert (four.url, four.summary, four.published_at) == ("http://a/44", None, new) and five.published_at == new
    assert (six.url, six.summary, six.published_at) == ("u", "x", new) and (seven.url, seven.summary, seven.published_at) == ("v", "s", None)
    bad = {r.source: r.reason for r in feeds.unread_feeds(docs).collect()}
    assert bad == {"d": "not readable", "e": "not readable", "f": "empty", "g": "no items"}


def test_feed_times(spark):
    want = {
        "Wed, 03 Jan 2024 08:00:00 +0800": 0, "3 Jan 2024 00:00:00 GMT": 0, "03 Jan 2024 01:00 +0100": 0, "2024-01-03": 0, "2024-01-03 00:00:00": 0, "2024-01-03T00:00:00Z": 0,
        "2024-01-03T00:00:00": 0, "2024-01-03T05:30:00+05:30": 0, "2024-01-03 02:00:00 +0000": 7200, "yesterday": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in want], "t string").withColumn("at", F.unix_timestamp(feeds.feed_time(F.col("t"))))
    assert {r.t: None if r.at is None else r.at - 1704240000 for r in df.collect()} == want


def test_database_is_read_in_ranges(spark):
    url = portfolio.database(spark, lake.scratch(spark, "db"))
    navs = [(i, dt.date(2024, 1, 1 + i % 20), 1.0 + i, 2.0 + i, None) for i in range(40)] + [(99, dt.date(2024, 1, 1), 1.0, 1.0, 0.5)]
    portfolio.to_database(spark.createDataFrame(navs, "instrument_id long, nav_date date, unit_nav double, accumulated_nav double, daily_growth_rate double"), url, "fund_navs")
    portfolio.to_database(spark.createDataFrame([(i, f"F{i}") for i in range(40)], "id long, code string"), url, "instruments")
    got = portfolio.fund_navs(spark, url, parts=5)
    assert sorted(map(tuple, got.collect())) == sorted((f"F{i}", d, a, b, g) for i, d, a, b, g in navs[:-1])
    some = portfolio.fund_navs(spark, url, parts=5, codes=["F3", "F4"])
    assert {r.fund_code for r in some.collect()} == {"F3", "F4"}
    plan = some.where("effective_date >= '2024-01-04'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(NAV_DATE" in plan and "In(CODE" in plan.replace("*In", "In")
    assert portfolio.jdbc_table(spark, url, "fund_navs", "INSTRUMENT_ID", 0, 100, 5).rdd.getNumPartitions() == 5


def test_codes_in_texts(spark, monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(3000)] + ["", None]
    table = [(f"c{rng.randrange(400)}", w) for w in words] + [(None, "a")]
    texts = [(i % 150, "".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 60)))) for i in range(200)] + [(500, None), (None, "ab"), (501, "")]
    df, keys = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(table, "code string, keyword string")
    want = sorted(((i, sorted({c for c, w in table if c and w and t and w in t})) for i, t in texts), key=str)
    for size in (8 << 20, 4000):
        monkeypatch.setattr(keywords, "BLOCK_BYTES", size)
        assert sorted(((r.id, r.codes) for r in keywords.match_codes(df, keys, "id", "text").collect()), key=str) == want
    assert {tuple(r.codes) for r in keywords.match_codes(df, keys.limit(0), "id", "text").collect()} == {()}
