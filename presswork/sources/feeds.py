"""Sources: fetched pages, Atom feeds, logs. Live fetching is an interface only; pages come as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.functions import urls

PAGES = "page_id long, url string, html string"
LOG = "ts timestamp, level string, site string, msg string"


def read_pages(spark: SparkSession, path: str, engine: str = "table") -> DataFrame:
    """Fetched pages. Engines other than `table` need a network and have to be registered as Spark data sources of that name."""
    if engine == "table":
        return spark.read.schema(PAGES).parquet(path)
    return spark.read.format(engine).schema(PAGES).load(path)


def clean_title(title: Column) -> Column:
    """Without tags, with numeric entities of printable ASCII decoded."""
    plain = F.regexp_replace(title, r"<[^>]*>", "")
    for code in range(32, 127):
        plain = F.replace(plain, F.lit(f"&#{code};"), F.lit(chr(code)))
    return F.replace(plain, F.lit("&amp;"), F.lit("&"))


def atom_entries(entries: DataFrame, most: int = 0) -> DataFrame:
    """(url, title, published) of Atom entries with ord, link, title, published: redirects unwrapped, web addresses only, newest first."""
    url = urls.unwrap_redirect(F.col("link"))
    out = entries.select("ord", url.alias("url"), clean_title(F.col("title")).alias("title"), F.col("published").cast("timestamp").alias("published"))
    ordered = out.where(F.col("url").rlike("^https?://")).orderBy(F.coalesce("published", F.timestamp_millis(F.lit(0))).desc(), "ord")
    return ordered.limit(most) if most else ordered


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files."""
    schema = "id string, title string, published timestamp, link struct<_href:string>"
    entries = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return entries.select(F.monotonically_increasing_id().alias("ord"), F.col("link._href").alias("link"), "title", "published")


def read_log(spark: SparkSession, path: str, site: str | None = None, last: int = 50) -> DataFrame:
    """The last lines of a JSON-lines log, of one site or all; lines that can't be read are dropped."""
    log = spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path).where("ts IS NOT NULL")
    log = log.where(F.col("site") == site) if site else log
    return log.orderBy(F.desc("ts")).limit(last)
