"""A batch of fetched pages against the store: what becomes of every page, and the rows that follow from it.

Outcomes: `listing` and `known` pages are skipped before they are parsed; of the others, `failed` ones have no article,
`paywalled` ones hold a marker of their site, a `duplicate` has the address of a stored item or of an earlier page of the
batch, with or without a slash at the end, and the rest are `new`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions import dates, html, records, text, urls
from presswork.operators import feeds, quality

SKIPPED = ("listing", "known")


def known_keys(items: DataFrame) -> DataFrame:
    """(site, key, stored) of stored items with site, url and hash: the key is the hash of the address without a slash at the end."""
    return items.select("site", urls.twin_hashes(F.col("url"))[0].alias("key"), "hash").groupBy("site", "key").agg(F.min("hash").alias("stored"))


def judge(
    pages: DataFrame,
    known: DataFrame,
    sections: DataFrame | None = None,
    sites: DataFrame | None = None,
    paywall: list[str] | None = None,
    ad_markers: list[str] | None = None,
    store_raw: bool = True,
    reply: Column | None = None,
    model: str | None = None,
) -> DataFrame:
    """Every page with its outcome, and the columns of its article.

    pages: page_id, url, html, site, section, first_seen. known: see `known_keys`. sections (site, index_url): their own
    pages are listings. sites (site, config_json): markers, and whether raw pages are kept; what a site doesn't set is as
    the arguments say, and a site can only switch raw pages off. `reply`: of a model, for new articles.
    """
    address = urls.normalize_url(F.col("url"))
    rows = pages.withColumn("address", address).withColumn("key", urls.twin_hashes(F.col("address"))[0]).withColumn("path", urls.bare_path(F.col("address")))
    rows = rows.join(known, ["site", "key"], "left")
    if sections is None:
        rows = rows.withColumn("is_listing", F.lit(False))
    else:
        index = sections.select("site", urls.bare_path(F.col("index_url")).alias("path")).distinct().withColumn("is_listing", F.lit(True))
        rows = rows.join(index, ["site", "path"], "left")
    config = F.lit(None).cast("string") if sites is None else F.col("config_json")
    if sites is not None:
        rows = rows.join(sites.select("site", "config_json").dropDuplicates(["site"]), "site", "left")
    markers = lambda x: F.array(*map(F.lit, x or [])).cast("array<string>")
    rows = rows.withColumn("config", records.site_config(config))
    before = F.when(F.col("is_listing"), "listing").when(F.col("stored").isNotNull(), "known")
    # Only what is still open is parsed: a null page costs nothing.
    rows = rows.withColumn("early", before).withColumn("open_html", F.when(F.col("early").isNull() & F.col("address").isNotNull(), F.col("html")))
    f = html.page_fields(F.col("open_html"), F.col("url"), F.coalesce("config.extract.ad_markers", markers(ad_markers)))
    parsed = rows.withColumn("f", f)
    error = F.when(F.col("address").isNull(), "the address can't be read").when(F.coalesce("html", F.lit("")) == "", "the page is empty").when(F.col("f.content").isNull(), "no article on the page")
    paid = text.has_marker(F.col("f.content_text"), F.coalesce("config.extract.paywall_markers", markers(paywall)))
    same = lambda a, b: urls.origin(a) == urls.origin(b)
    own = urls.normalize_url(feeds.canonical_url(F.col("address"), F.col("f.metadata.canonical"), F.col("f.metadata.ogUrl"), same))
    told = parsed.withColumn("error", F.when(F.col("early").isNull(), error)).withColumn("outcome", F.coalesce("early", F.when(F.col("error").isNotNull(), "failed"), F.when(paid, "paywalled")))
    told = told.withColumn("own", F.coalesce(own, "address")).drop("key", "stored")
    # Rows that aren't to be stored have keys of their own, so they neither meet others nor each other.
    named = told.withColumn("key", F.when(F.col("outcome").isNull(), urls.twin_hashes(F.col("own"))[0]).otherwise(F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string"))))
    again = named.join(known, ["site", "key"], "left").withColumn("hash", F.sha1("own"))
    order = Window.partitionBy("site", "key").orderBy("first_seen", "own", "page_id")
    again = again.withColumn("place", F.row_number().over(order)).withColumn("hash", F.coalesce("stored", F.first("hash").over(order)))
    again = again.withColumn("outcome", F.coalesce("outcome", F.when(F.col("stored").isNotNull() | (F.col("place") > 1), "duplicate"), F.lit("new")))
    published = dates.parse_date(F.col("f.metadata.publishedAt"))
    new = F.col("outcome") == "new"
    keep_raw = F.lit(store_raw) & F.coalesce("config.extract.storeRaw", F.lit(True))
    llm = F.lit(None)
    if reply is not None:
        fields = records.llm_fields(F.when(new, reply), F.col("f.content_text"))
        llm = F.when(fields.isNotNull(), F.struct(*(fields[x].alias(x) for x in ("title", "html", "text", "url", "publishedAt")), F.lit(model).alias("model"), F.col("first_seen").alias("extractedAt")))
    return again.select(
        "site",
        "section",
        "page_id",
        "address",
        "outcome",
        "error",
        ((F.col("outcome") == "failed") & F.coalesce(text.is_bot_gate(F.col("html")), F.lit(False))).alias("retry"),
        F.when(F.col("outcome").isin("new", "duplicate"), F.col("hash")).alias("hash"),
        F.col("own").alias("url"),
        F.coalesce(feeds.first_filled(F.col("f.metadata.title"), F.col("f.title")), F.lit("Untitled")).alias("title"),
        published.alias("published_at"),
        "first_seen",
        F.sha1("f.content").alias("content_hash"),
        F.col("f.content").alias("content_html"),
        F.col("f.content_text").alias("text"),
        F.when(keep_raw, F.col("html")).alias("raw_html"),
        F.col("f.metadata.author").alias("author"),
        F.col("f.metadata.image").alias("image"),
        F.col("f.metadata").alias("metadata"),
        llm.alias("llm"),
        (text.body_good(F.col("f.content_text")) & new).alias("body_good"),
        (published.isNotNull() & new).alias("date_good"),
    )


def new_items(batch: DataFrame) -> DataFrame:
    return batch.where("outcome = 'new'")


def memberships(batch: DataFrame) -> DataFrame:
    """(site, section, hash): a known article that another section lists only gets a membership."""
    return batch.where("outcome IN ('new', 'duplicate')").select("site", "section", "hash").distinct()


def failures(batch: DataFrame) -> DataFrame:
    """Pages without an article; `retry` marks challenge pages, which another engine may get."""
    return batch.where("outcome = 'failed'").select("site", "section", F.col("address").alias("url"), "page_id", "error", "retry")


def run_rows(batch: DataFrame, idle: DataFrame | None = None) -> DataFrame:
    """One finished run of each site: counters, status, first error, excerpt of errors, quality of the new items.

    idle: sites without any section, which end in an error.
    """
    is_ = lambda *outcomes: F.col("outcome").isin(*outcomes)
    counts = batch.groupBy("site").agg(
        F.count("*").alias("discovered"),
        F.count_if(is_("new")).alias("new_items"),
        F.count_if(is_("failed")).alias("failed"),
        F.count_if(is_("paywalled")).alias("paywalled"),
        F.count_if(is_(*SKIPPED)).alias("skipped"),
        F.count_if(is_("duplicate")).alias("duplicates"),
        F.count_if("body_good").alias("body_ok"),
        F.count_if("date_good").alias("date_ok"),
    )
    message = F.concat(F.lit("parse "), F.coalesce("url", F.lit("?")), F.lit(": "), F.col("error"))
    errors = failures(batch).withColumn("message", message)
    counts = counts.join(quality.error_excerpt(errors, ["site"], "page_id", "message"), "site", "left")
    counts = counts.withColumn("status", quality.run_status(F.lit(False), F.lit(1), F.col("failed")))
    if idle is not None:
        none = idle.select("site").distinct().join(batch.select("site").distinct(), "site", "left_anti")
        why = F.lit("the site has no section")
        zeros = [F.lit(0).cast("long").alias(c) for c in counts.columns if c not in ("site", "error", "log_excerpt", "status")]
        counts = counts.unionByName(none.select("site", *zeros, why.alias("error"), why.alias("log_excerpt"), F.lit("error").alias("status")))
    return counts
