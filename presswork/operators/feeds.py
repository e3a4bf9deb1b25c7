"""Feeds and status: top items of a feed, fields of a model over those of the page, RSS documents, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions import dates, records, text

COUNT_CAP = 100_000
INDEX_ITEMS = 500


def feed_order(published: str = "published_at", seen: str = "first_seen", key: str = "hash") -> list[Column]:
    """Undated items last, then newest first; the key settles ties."""
    return [F.col(published).isNull().asc(), F.coalesce(published, seen).desc(), F.col(seen).desc(), F.col(key).asc()]


def top_items(items: DataFrame, limit: int = 10, **columns: str) -> DataFrame:
    """The first items of one feed; 0 is all."""
    ordered = items.orderBy(*feed_order(**columns))
    return ordered.limit(limit) if limit else ordered


def top_items_per(items: DataFrame, feed: list[str], limit: int = 10, **columns: str) -> DataFrame:
    """The first items of every feed at once, with their `rank`."""
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy(*feed).orderBy(*feed_order(**columns))))
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def feed_fields(items: DataFrame, prefer_model: Column, no_images: Column) -> DataFrame:
    """The served fields of items (after the limit, as this is the expensive part): a model's over the page's where the feed wants them."""
    model = lambda name: F.when(prefer_model, F.when(F.col(f"llm.{name}") != "", F.col(f"llm.{name}")))
    html = F.coalesce(model("html"), "content_html")
    return items.select(
        "site",
        "hash",
        F.coalesce(model("title"), "title").alias("title"),
        F.coalesce(model("url"), "url").alias("link"),
        F.coalesce(F.try_to_timestamp(model("publishedAt")), "published_at", "first_seen").alias("pub_date"),
        F.coalesce(model("text"), "text").alias("description"),
        F.when(no_images, text.strip_images(html)).otherwise(html).alias("content"),
        "author",
        "first_seen",
    )


def with_settings(items: DataFrame, sites: DataFrame, ignore_images: bool = False, feed_source: str = "tags") -> DataFrame:
    """Items with what their site's settings say of serving: `prefer_model` and `no_images`. sites: site, config_json.

    A site's own setting wins over the instance's, which the arguments are; a setting of another kind, or settings that can't be read, count as none.
    """
    config = records.site_config(F.col("config_json"))
    source = F.when(config["extract"]["feedSource"].isin("llm", "tags"), config["extract"]["feedSource"])
    own = sites.select("site", F.coalesce(source, F.lit(feed_source)).alias("_source"), F.coalesce(config["ignore_images"], F.lit(ignore_images)).alias("_plain"))
    joined = items.join(own.dropDuplicates(["site"]), "site", "left")
    return joined.select(*items.columns, (F.coalesce("_source", F.lit(feed_source)) == "llm").alias("prefer_model"), F.coalesce("_plain", F.lit(ignore_images)).alias("no_images"))


def rss_item(title: Column, link: Column, guid: Column, date: Column, description: Column, content: Column, author: Column) -> Column:
    """One item of an RSS document. Parts that are empty are left out."""
    part = lambda tag, body: F.concat(F.lit(f"      <{tag}>"), body, F.lit(f"</{tag.split(' ')[0]}>\n"))
    safe = lambda x: F.concat(F.lit("<![CDATA["), text.cdata(x), F.lit("]]>"))
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    return F.concat(
        F.lit("    <item>\n"),
        part("title", text.escape_xml(title)),
        part("link", text.escape_xml(link)),
        part('guid isPermaLink="false"', text.escape_xml(guid)),
        part("pubDate", dates.rfc822(date)),
        F.when(some(description), part("description", safe(description))).otherwise("      <description/>\n"),
        F.when(some(content), part("content:encoded", safe(content))).otherwise(""),
        F.when(some(author), part("dc:creator", text.escape_xml(author))).otherwise(""),
        F.lit("    </item>\n"),
    )


def join_items(ranked: DataFrame, feed: list[str], item: str, rank: str = "rank") -> DataFrame:
    """The items of each feed in order, as one text. A feed has a limited number of them by now."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(rank, item))), lambda x: x[item])
    return ranked.groupBy(*feed).agg(F.array_join(ordered, "").alias("items"))


def rss_document(title: Column, link: Column, description: Column, built: Column, ttl: Column, feed_url: Column, items: Column) -> Column:
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"\n     xmlns:content="http://purl.org/rss/1.0/modules/content/"\n     xmlns:dc="http://purl.org/dc/elements/1.1/"\n     xmlns:atom="http://www.w3.org/2005/Atom">\n  <channel>\n'
    part = lambda tag, body: F.concat(F.lit(f"    <{tag}>"), body, F.lit(f"</{tag}>\n"))
    return F.concat(
        F.lit(head),
        part("title", text.escape_xml(title)),
        part("link", text.escape_xml(link)),
        part("description", text.escape_xml(description)),
        part("lastBuildDate", dates.rfc822(F.coalesce(built, F.timestamp_millis(F.lit(0))))),
        part("ttl", ttl.cast("string")),
        F.lit('    <atom:link href="'),
        text.escape_xml(feed_url),
        F.lit('" rel="self" type="application/rss+xml"/>\n'),
        F.coalesce(items, F.lit("")),
        F.lit("  </channel>\n</rss>\n"),
    )


def site_status(sites: DataFrame, sections: DataFrame, items: DataFrame) -> DataFrame:
    """Per site: sections and items, zeros kept, items capped for display."""
    n_sections = sections.groupBy("site").agg(F.count("*").alias("n_sections"))
    n_items = items.groupBy("site").agg(F.count("*").alias("n_items"))
    joined = sites.join(n_sections, "site", "left").join(n_items, "site", "left")
    return joined.select("site", F.coalesce("n_sections", F.lit(0)).alias("n_sections"), F.least(F.coalesce("n_items", F.lit(0)), F.lit(COUNT_CAP)).alias("n_items"))


def grand_total(items: DataFrame) -> DataFrame:
    """One row: items, and sites that have any."""
    return items.groupBy("site").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.count("*").alias("n_sites"))


def section_counts(memberships: DataFrame, keys: list[str]) -> DataFrame:
    """Items of each section (`keys`); a membership that repeats counts once."""
    return memberships.select(*keys, "hash").distinct().groupBy(*keys).agg(F.count("*").alias("n_items"))


def site_listing(sites: DataFrame, runs: DataFrame) -> DataFrame:
    """Sites with when and how their last run ended. runs: site, id, finished_at, status, error."""
    last = runs.where("finished_at IS NOT NULL").groupBy("site").agg(F.max_by(F.struct("finished_at", "status", "error"), F.struct("finished_at", "id")).alias("last"))
    own = sites.drop("last_scrape_at", "last_scrape_status", "last_error").join(last, "site", "left")
    return own.select("*", F.col("last.finished_at").alias("last_scrape_at"), F.col("last.status").alias("last_scrape_status"), F.col("last.error").alias("last_error")).drop("last")


def status_json(status: DataFrame) -> DataFrame:
    return status.select("site", F.to_json(F.struct("site", "n_sections", "n_items")).alias("status"))


def canonical_url(fetched: Column, canonical: Column, og_url: Column, same_origin) -> Column:
    """The page's canonical address if it is of the fetched origin, else its own address if that is, else the fetched one."""
    return F.when(same_origin(canonical, fetched), canonical).when(same_origin(og_url, fetched), og_url).otherwise(fetched)


def first_filled(*values: Column) -> Column:
    """The first value that isn't null, blank, or a placeholder title."""
    return F.coalesce(*(F.when((F.trim(v) != "") & (v != "Untitled"), v) for v in values))
