"""Records in the embedded JSON of pages, as variants: found level by level, at any nesting, without a Python worker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.functions import urls
from presswork.functions.html import DATE_KEYS, TITLE_KEYS, URL_KEYS
from presswork.session import stored

SCRIPT = r'(?is)<script\b[^>]*\btype\s*=\s*["\']?application/json["\']?[^>]*>(.*?)</script>'
#: Where a script isn't JSON, addresses are picked by these keys.
PICKED = r'"(?:' + "|".join(URL_KEYS) + r')"\s*:\s*"((?:[^"\\]|\\.)+)"'


def scripts(pages: DataFrame) -> DataFrame:
    """(page_id, index_url, script, json) of the JSON scripts of pages (page_id, url, html)."""
    found = pages.select("page_id", F.col("url").alias("index_url"), F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))).alias("script", "json"))
    return found.where(F.trim("json") != "")


def resolved(address: Column, base: Column) -> Column:
    """A record's address in full: whole ones as they are, those from the root or of a sibling against the page's."""
    own, folder = urls.origin(base), F.regexp_replace(urls.path(base), "[^/]*$", "")
    a = F.trim(address)
    return (
        F.when(a.rlike("(?i)^https?://"), a)
        .when(a.startswith("//"), F.concat(F.regexp_extract(own, "^[a-z]+:", 0), a))
        .when(a.startswith("/"), F.concat(own, a))
        .when(a.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(F.concat(own, F.when(folder == "", "/").otherwise(folder), a))
    )


def _text(node: Column, keys: list[str]) -> Column:
    """The first of the keys that an object (a map of variants) has as a text that isn't blank."""
    each = []
    for key in keys:
        value = F.try_element_at(node, F.lit(key))
        text = F.when(F.schema_of_variant(value) == "STRING", F.trim(F.try_variant_get(value, "$", "string")))
        each.append(F.when(text != "", text))
    return F.coalesce(*each)


def embedded_records(pages: DataFrame) -> DataFrame:
    """(page_id, index_url, url, title, date, source, depth) of every object in a JSON script that has an address of its page's origin.

    All objects and lists of one level are one step, until no level is left, so there are as many steps as the deepest script is nested. A
    script that isn't JSON gives the addresses that a pattern finds, with the source `uri-regex`. Scripts of any length stay in the JVM.
    """
    parsed = stored(scripts(pages).withColumn("v", F.try_parse_json("json")))
    broken = parsed.where("v IS NULL").select("page_id", "index_url", F.explode(F.array_distinct(F.regexp_extract_all("json", F.lit(PICKED), F.lit(1)))).alias("address"))
    picked = broken.select("page_id", "index_url", F.replace("address", F.lit("\\/"), F.lit("/")).alias("address"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("date"), F.lit("uri-regex").alias("source"), F.lit(0).alias("depth"))
    level, depth, out = parsed.where("v IS NOT NULL").select("page_id", "index_url", "v"), 0, picked
    spark = pages.sparkSession
    while True:
        kind = F.schema_of_variant("v")
        objects = level.where(kind.startswith("OBJECT")).withColumn("v", F.try_variant_get("v", "$", "map<string,variant>"))
        told = objects.select("page_id", "index_url", _text(F.col("v"), URL_KEYS).alias("address"), _text(F.col("v"), TITLE_KEYS).alias("title"), _text(F.col("v"), DATE_KEYS).alias("date"), F.lit("json").alias("source"), F.lit(depth).alias("depth"))
        out = out.unionByName(told.where("address IS NOT NULL"))
        nested = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        below = nested.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("page_id", "index_url", F.col("value").alias("v"))
        deeper = F.schema_of_variant("v")
        level = stored(below.where(deeper.startswith("OBJECT") | deeper.startswith("ARRAY")))
        depth += 1
        if level.isEmpty():
            break
    whole = stored(out).withColumn("url", resolved(F.col("address"), F.col("index_url")))
    return whole.where(urls.origin(F.col("url")) == urls.origin(F.col("index_url"))).select("page_id", "index_url", "url", "title", "date", "source", "depth")
