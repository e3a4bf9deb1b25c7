"""Served fields, RSS documents, link inventories and metadata maps."""

import xml.etree.ElementTree as ET
from datetime import datetime

from pyspark.sql import functions as F

from presswork.functions import dates, records
from presswork.operators import discover, feeds
from presswork.schemas import ITEMS, conform


def item(spark, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    llm = F.struct(F.lit("model title").alias("title"), F.lit("").alias("html"), F.lit("model text").alias("text"), F.lit(None).cast("string").alias("url"), F.lit("2026-01-02").alias("publishedAt"), F.lit("m").alias("model"), F.lit(None).cast("timestamp").alias("extractedAt"))
    return conform(row.withColumn("llm", llm), ITEMS)


def test_fields_of_a_model_win_where_they_are_wanted(spark):
    one = item(spark, site="s", hash="h", url="https://e/x", title="page title", content_html="<p>a<img src='x'></p>", text="page text", first_seen=datetime(2026, 1, 1))
    plain = feeds.feed_fields(one, F.lit(False), F.lit(False)).first()
    assert (plain.title, plain.description, plain.content, plain.pub_date) == ("page title", "page text", "<p>a<img src='x'></p>", datetime(2026, 1, 1))
    model = feeds.feed_fields(one, F.lit(True), F.lit(True)).first()
    assert (model.title, model.description, model.content, model.pub_date, model.link) == ("model title", "model text", "<p>a</p>", datetime(2026, 1, 2), "https://e/x")


def test_rss_document_is_xml(spark):
    ranked = spark.createDataFrame([("s", 2, "B & b", "x ]]> y"), ("s", 1, "A <a>", None)], "site string, rank int, title string, html string")
    at = F.lit(datetime(2026, 8, 5, 1, 2, 3))
    none = F.lit(None).cast("string")
    one = feeds.rss_item(F.col("title"), F.lit("https://e/?a=1&b=2"), F.col("title"), at, none, F.col("html"), F.lit("Ann"))
    joined = feeds.join_items(ranked.withColumn("item", one), ["site"], "item")
    doc = joined.select(feeds.rss_document(F.lit("T"), F.lit("https://e"), F.lit("D"), F.lit(None).cast("timestamp"), F.lit(15), F.lit("https://e/s.xml"), F.col("items")).alias("x")).first().x
    channel = ET.fromstring(doc.encode()).find("channel")
    items = channel.findall("item")
    assert [i.find("title").text for i in items] == ["A <a>", "B & b"]
    assert items[1].find("{http://purl.org/rss/1.0/modules/content/}encoded").text == "x ]]> y"
    assert items[0].find("pubDate").text == "Wed, 05 Aug 2026 01:02:03 GMT" and channel.find("lastBuildDate").text == "Thu, 01 Jan 1970 00:00:00 GMT"


def test_link_inventory(spark):
    raw = spark.createDataFrame([(1, 0, "u", None), (1, 1, "u", "later"), (1, 2, "v", "x" * 200)], "page_id int, ord int, url string, title string")
    assert {(r.url, r.ord, r.text) for r in discover.link_inventory(raw).collect()} == {("u", 0, ""), ("v", 2, "x" * 90)}


def test_metadata_map_and_visible_date(spark):
    row = spark.range(1).select(F.create_map(F.lit("ogTitle"), F.lit("T"), F.lit("title"), F.lit("")).alias("m"), F.lit("By X, July 28, 2026 and 1 May 2025").alias("t"))
    got = row.select(records.api_metadata(F.col("m")).alias("a"), F.lit(dates.written_date("By X, July 28, 2026 and 1 May 2025")).alias("d")).first()
    assert got.a.title == "T" and got.a.author is None and got.d == "July 28, 2026"
