"""JSON values: site settings, metadata of an API, and replies of a language model."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.schemas import CONFIG

# Defaults of a site's settings.
MODE, MAX_CANDIDATES, FOLLOW, FEED_ITEMS = "auto", 100, 3, 10
MODEL_BODY, TAG_BODY = 150, 1000


def site_config(text: Column) -> Column:
    """A site's settings as a struct; what can't be read is null."""
    return F.from_json(text, CONFIG, {"mode": "PERMISSIVE"})


def knob(own: Column, default: object) -> Column:
    """A setting over its default."""
    return F.coalesce(own, F.lit(default))


def profile_json(**knobs: tuple[Column, object]) -> Column:
    """Only the settings that differ from their defaults, as JSON: name=(value, default). Any number of them."""
    return F.to_json(F.struct(*(F.when(value != default, value).alias(name) for name, (value, default) in knobs.items())))


def drop_key(text: Column, key: str) -> Column:
    """A JSON object of texts without one key."""
    return F.to_json(F.map_filter(F.from_json(text, "map<string,string>"), lambda k, _: k != key))


def first_of(text: Column, *keys: str) -> Column:
    """The first of the keys that has a text which isn't blank."""
    return F.coalesce(*(F.when(F.trim(F.get_json_object(text, f"$.{k}")) != "", F.get_json_object(text, f"$.{k}")) for k in keys))


def api_metadata(values: Column) -> Column:
    """Title, author, date and image from the many names that an API's map has for them."""
    pick = lambda *keys: F.coalesce(*(F.when(values[k] != "", values[k]) for k in keys))
    return F.struct(
        pick("title", "ogTitle", "og:title").alias("title"),
        pick("author", "article:author", "twitter:creator").alias("author"),
        pick("publishedTime", "article:published_time", "datePublished", "date").alias("publishedAt"),
        pick("ogImage", "og:image", "twitter:image", "image").alias("image"),
    )


def first_object(reply: str | None) -> str | None:
    """The first whole JSON object of a reply, fenced or among prose, as JSON. Raw line breaks in its texts are allowed."""
    if not reply:
        return None
    fenced = re.search(r"(?is)```(?:json)?\s*(.*?)```", reply)
    text = fenced[1] if fenced else reply
    at = text.find("{")
    if at < 0:
        return None
    try:
        value, _ = json.JSONDecoder(strict=False).raw_decode(text, at)
    except ValueError:
        return None
    return json.dumps(value, ensure_ascii=False)


def _reply_json(reply: pd.Series) -> pd.Series:
    return reply.map(first_object)


def reply_json(reply: Column) -> Column:
    return F.pandas_udf(_reply_json, "string")(reply)


def llm_fields(reply: Column, tag_text: Column) -> Column:
    """struct of a model's reply, or null: nothing usable, or a stub where the page itself has a long text."""
    o = reply_json(reply)
    title, html = first_of(o, "title", "headline", "heading"), first_of(o, "html", "content", "body")
    plain = F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " "))
    text = F.coalesce(first_of(o, "text", "article_text"), plain)
    url, date = first_of(o, "url", "link", "canonical", "canonicalUrl"), first_of(o, "publishedAt", "datePublished", "published", "pubDate", "date")
    length = F.greatest(F.length(F.coalesce(text, F.lit(""))), F.length(F.coalesce(plain, F.lit(""))))
    stub = (length < MODEL_BODY) & (F.length(F.trim(F.regexp_replace(F.coalesce(tag_text, F.lit("")), r"\s+", " "))) >= TAG_BODY)
    empty = F.coalesce(title, html, text, url, date).isNull()
    return F.when(o.isNotNull() & ~stub & ~empty, F.struct(title.alias("title"), html.alias("html"), text.alias("text"), url.alias("url"), date.alias("publishedAt")))


def prompt(title: str, url: str, text: str, most: int = 40_000) -> str:
    """What a language model is asked for an article."""
    return f"Return one JSON object with the keys title, html, text, url and publishedAt of this article, word for word.\nURL: {url}\nTitle: {title}\n\n{text[:most]}"
