"""Text functions as column expressions. Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GOOD_BODY = 200
# Marks of a challenge page.
BOT_MARKERS = ["cf-chl", "challenge-platform", "cf-browser-verification", "cf-challenge", "__cf_chl_", "just a moment"]


def trim_space(text: Column) -> Column:
    """Without white space at both ends, including no-break and other Unicode spaces."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return trim_space(F.regexp_replace(text, r"(?U)\s+", " "))


def text_score(text: Column) -> Column:
    t = trim_space(F.coalesce(text, F.lit("")))
    n = F.length(t)
    return F.when((n >= 25) & (n <= 220) & t.rlike(r"(?U)\s"), 20).when(n >= 12, 9).otherwise(0)


def source_bonus(source: Column) -> Column:
    return F.when(source.isin("json", "jsonld"), 12).when(source == "uri-regex", 8).otherwise(5)


def _escape(text: Column, *pairs: tuple[str, str]) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for old, new in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), *pairs):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def escape_html(text: Column) -> Column:
    return _escape(text)


def escape_page(text: Column) -> Column:
    return _escape(text, ("'", "&#39;"))


def escape_xml(text: Column) -> Column:
    return _escape(text, ("'", "&apos;"))


def cdata(text: Column) -> Column:
    """The text for a CDATA section: an end mark inside is split over two sections."""
    return F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))


def text_to_html(text: Column) -> Column:
    """Blocks between blank lines as escaped paragraphs."""
    blocks = F.transform(F.split(text, r"\n{2,}"), lambda b: F.trim(F.regexp_replace(b, r"\n+", " ")))
    return F.array_join(F.transform(F.filter(blocks, lambda b: b != ""), lambda b: F.concat(F.lit("<p>"), escape_html(b), F.lit("</p>"))), "\n")


def strip_markdown(text: Column) -> Column:
    out = text
    for pattern, put in ((r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*\n]+)\*", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^>[ \t]?", ""), (r"`([^`]+)`", "$1")):
        out = F.regexp_replace(out, pattern, put)
    return out


def body_good(text: Column) -> Column:
    return F.length(trim_space(F.coalesce(text, F.lit("")))) >= GOOD_BODY


def is_bot_gate(html: Column) -> Column:
    lower = F.lower(html)
    hit = F.lit(False)
    for marker in BOT_MARKERS:
        hit = hit | lower.contains(marker)
    return (F.length(html) >= 200) & hit


def has_marker(text: Column, markers: Column) -> Column:
    """Whether the text holds any of the markers (an array), in any case. No markers: false."""
    lower = F.lower(text)
    return F.coalesce(F.exists(markers, lambda m: (m != "") & lower.contains(F.lower(m))), F.lit(False))


def is_throttle(message: Column) -> Column:
    return message.rlike(r"\b(403|420|429|503|529)\b") | F.lower(message).rlike(r"rate.?limit|throttl|too many requests|retry[- ]after")


def status_of(message: Column) -> Column:
    """The HTTP status that an error message tells: after an arrow at its end, else its last 4xx or 5xx."""
    arrow = F.regexp_extract(message, r"->\s*([0-9]{3})\s*$", 1)
    return F.when(arrow != "", arrow).otherwise(F.try_element_at(F.regexp_extract_all(message, F.lit(r"\b([45][0-9][0-9])\b"), 1), F.lit(-1)))


#: How long texts are where they are shown, by what they are for; fixed values.
CUTS = {"label": 40, "link": 90, "title": 200, "excerpt": 2000, "snapshot": 6000, "prompt": 40_000}


def cut(text: Column, kind: str) -> Column:
    """The text as far as its kind is shown."""
    return F.left(text, F.lit(CUTS[kind]))


def delay_band(site_low: Column, site_high: Column, low: Column, high: Column) -> Column:
    """Milliseconds (lower, upper) to wait: the site's over the default, 0 unless positive, in order."""
    ms = lambda x: F.when(x > 0, F.round(x * 1000)).otherwise(0).cast("long")
    a, b = ms(F.coalesce(site_low, low)), ms(F.coalesce(site_high, high))
    return F.struct(F.least(a, b).alias("lower"), F.greatest(a, b).alias("upper"))


def feed_title(site_title: Column, section_title: Column) -> Column:
    """The site's title if it already ends with the section's, else both."""
    return F.when(F.lower(site_title).endswith(F.lower(section_title)), site_title).otherwise(F.concat(site_title, F.lit(" - "), section_title))


def strip_styles(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<style\b[^>]*>.*?</style>", ""), r"(?i)<link\b[^>]*stylesheet[^>]*>", "")


def strip_images(html: Column) -> Column:
    """Without pictures, their captions, and the wrappers that this leaves empty (nested up to five deep)."""
    out = html
    for pattern in (r"(?is)<picture\b[^>]*>.*?</picture>", r"(?i)<img\b[^>]*>", r"(?is)<figcaption\b[^>]*>.*?</figcaption>", r"(?i)<figure\b[^>]*>\s*</figure>"):
        out = F.regexp_replace(out, pattern, "")
    for _ in range(5):
        out = F.regexp_replace(out, r"(?i)<(div|section|article|span)\b[^>]*>\s*</\1>", "")
    return out


def page_title(html: Column) -> Column:
    """The page's title, 200 characters at most."""
    return F.left(collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(200))
