"""URL and identifier functions as column expressions. A URL that can't be parsed gives null rather than an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "ref", "referrer", "ref_src", "fbclid", "gclid", "mc_cid", "mc_eid", "igshid", "sc_campaign", "sc_channel"]
# Path segments that no article has.
NOT_ARTICLE = [
    "category", "categories", "tag", "tags", "author", "authors", "archive", "archives", "page", "pages", "wp-json", "wp-content", "wp-admin", "wp-includes", "login", "signup", "register", "subscribe",
    "contact", "about", "privacy", "terms", "legal", "cookies", "feed", "rss", "sitemap", "search", "search-on", "submit", "selfservice", "licensing", "email-alerts",
]
# Extensions of files that aren't pages.
BINARY = ["png", "jpg", "jpeg", "gif", "webp", "svg", "css", "js", "json", "xml", "csv", "pdf", "zip", "gz", "mp4", "mp3", "wav", "mov", "ico"]
# Last segments of listing pages.
LISTING = ["news", "archive", "articles", "stories", "latest", "all", "more", "listing", "browse", "headlines", "index"]
# Identifiers that routes need.
RESERVED = ["health", "opml", "item", "status"]

ORIGIN_PATTERN = r"^([a-z]+://[^/?#]+)"


def with_scheme(url: Column) -> Column:
    """Protocol-relative addresses become https."""
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def origin(url: Column) -> Column:
    """Scheme and host in lower case, without a default port; null where there is none."""
    whole = F.lower(F.regexp_extract(with_scheme(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))
    plain = F.regexp_replace(F.regexp_replace(whole, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    return F.when(plain != "", plain)


def host(url: Column) -> Column:
    return F.regexp_extract(origin(url), r"^[^:]+://([^/:]+)", 1)


def path(url: Column) -> Column:
    """The path as given, `/` where there is none."""
    found = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def bare_path(url: Column) -> Column:
    """The path without slashes at its end."""
    return F.regexp_replace(path(url), r"/+$", "")


def normalize_url(url: Column) -> Column:
    """The form by which pages are told apart: lower-case origin, single slashes in the path, no tracking parameters, no fragment."""
    kept = F.array_join(F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, r"^([^=]*)", 1)).isin(TRACKING)), "&")
    return F.concat(origin(url), F.regexp_replace(path(url), r"/{2,}", "/"), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def url_hash(url: Column) -> Column:
    return F.sha1(url)


def slash_hashes(url: Column) -> Column:
    """Hashes of the address, and of it without slashes at its end where that differs."""
    return F.array_distinct(F.array(F.sha1(url), F.sha1(F.regexp_replace(url, r"/+$", ""))))


def twin_hashes(url: Column) -> Column:
    """Hashes of both spellings: without and with a slash at the end."""
    bare = F.regexp_replace(url, r"/+$", "")
    return F.array(F.sha1(bare), F.sha1(F.concat(bare, F.lit("/"))))


def is_usable(url: Column) -> Column:
    """Whether a page may be an article by its path: no file, no listing word, two segments at least."""
    lower = F.lower(path(url))
    words = "|".join(NOT_ARTICLE)
    return ~lower.rlike(rf"\.({'|'.join(BINARY)})$") & ~lower.rlike(rf"(^|/)({words})(/|$)") & (F.size(segments(url)) >= 2)


def is_article_like(url: Column) -> Column:
    p = path(url)
    return F.lower(p).rlike("/article/") | p.rlike(r"/[0-9]{4}/")


def is_listing_like(url: Column) -> Column:
    p = F.lower(bare_path(url))
    return p.rlike(r"/page/[0-9]+$") | F.lower(query(url)).rlike(r"(^|&)(page|paged|pg)\s*=\s*[0-9]+") | p.rlike(rf"({'|'.join(LISTING)})$")


def page_number(url: Column) -> Column:
    q = F.concat(F.lit("&"), query(url), F.lit("&"))
    named = [F.regexp_extract(q, rf"&{n}=([0-9]+)&", 1) for n in ("page", "paged", "pg")]
    in_path = F.regexp_extract(F.lower(path(url)), r"/page/([0-9]+)/?$", 1)
    return F.coalesce(*(F.when(x != "", x) for x in (*named, in_path))).cast("int")


def path_score(url: Column) -> Column:
    """A year counts 25, year/month/day 20 more, three to nine segments 8."""
    p, n = path(url), F.size(segments(url))
    return F.when(p.rlike(r"\b[0-9]{4}\b"), 25).otherwise(0) + F.when(p.rlike(r"\b[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}\b"), 20).otherwise(0) + F.when((n >= 3) & (n <= 9), 8).otherwise(0)


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def prettify(slug: Column) -> Column:
    """`some-topic` as `Some Topic`."""
    words = F.filter(F.split(slug, "[-_]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def is_identifier(text: Column) -> Column:
    return text.rlike("^[a-z0-9-]{1,40}$") & ~text.isin(RESERVED)


def section_id(url: Column) -> Column:
    """A slug of the last segment (percent-encoded, as an address has it), or `index`."""
    last = F.regexp_replace(F.regexp_replace(F.coalesce(F.try_element_at(segments(url), F.lit(-1)), F.lit("")), " ", "%20"), "%21", "!")
    slug = slugify(F.regexp_replace(last, r"\.[A-Za-z0-9]+$", ""))
    return F.when(slug != "", slug).otherwise("index")


def index_url(url: Column) -> Column:
    """The address of a listing as a section keeps it: origin and path, without doubled slashes, one at the end, query or fragment."""
    return F.concat(origin(url), F.array_join(F.transform(segments(url), lambda s: F.concat(F.lit("/"), s)), ""))


def site_id(url: Column) -> Column:
    """The label before the last of the host, `visa` of `investor.visa.com`."""
    labels = F.split(host(url), r"\.")
    return slugify(F.when(F.size(labels) >= 2, F.try_element_at(labels, F.lit(-2))).otherwise(F.try_element_at(labels, F.lit(1))))


def unwrap_redirect(url: Column) -> Column:
    """The target of an address that carries it as its `url` parameter."""
    inner = F.regexp_extract(url, r"[?&]url=([^&#]+)", 1)
    return F.when(inner != "", F.try_url_decode(inner)).otherwise(url)


def strip_extension(segment: Column) -> Column:
    return F.regexp_replace(segment, r"\.(xml|html)$", "")
