"""Page, URL, text and date queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.functions import html, text, urls
from presswork.operators import discover, feeds, items
from presswork.plans.registry import query, table
from presswork.sources import feeds as sources

TRACK = "|".join(urls.TRACKING)
NORM = (
    "(lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) || regexp_replace(CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END, '/{2,}', '/', 'g')"
    " || coalesce((SELECT '?' || string_agg(p, '&' ORDER BY i) FROM (SELECT unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS p, unnest(range(len(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')))) AS i)"
    f" WHERE p <> '' AND NOT regexp_matches(p, '(?i)^({TRACK})(=|$)')), ''))"
)
PATH = "(CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END)"
HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"


def pages(spark, sf_dir):
    return sources.read_pages(spark, f"{sf_dir}/pages.parquet")


@query(f"SELECT page_id, u AS url, sha1(u) AS hash FROM (SELECT page_id, {NORM} AS u FROM pages)")
def normalize_url_hash(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.normalize_url(F.col("url")).alias("url")).withColumn("hash", urls.url_hash(F.col("url")))


@query(f"""SELECT page_id, sha1(rtrim(u, '/')) AS bare, sha1(rtrim(u, '/') || '/') AS slashed, CASE WHEN ends_with(u, '/') THEN 2 ELSE 1 END AS n_hashes FROM (SELECT page_id, {NORM} AS u FROM pages)""")
def slash_twin_hashes(spark, sf_dir):
    u = urls.normalize_url(F.col("url"))
    return pages(spark, sf_dir).select("page_id", urls.twin_hashes(u).alias("t"), F.size(urls.slash_hashes(u)).alias("n_hashes")).select("page_id", F.col("t")[0].alias("bare"), F.col("t")[1].alias("slashed"), "n_hashes")


@query(f"""WITH p AS (SELECT page_id, rtrim({NORM}, '/') AS u FROM pages), known AS (SELECT u FROM p WHERE contains(u, '.example.com'))
SELECT page_id FROM p WHERE u NOT IN (SELECT u FROM known)""")
def known_filter_two_keys(spark, sf_dir):
    """Pages of which the store has neither spelling."""
    seen = pages(spark, sf_dir).select("page_id", F.lit("s").alias("site"), urls.normalize_url(F.col("url")).alias("url"))
    store = seen.where(F.col("url").contains(".example.com")).select("site", F.sha1("url").alias("hash"))
    return items.unknown(seen, store).select("page_id")


@query(f"""WITH p AS (SELECT page_id, {HOST} AS site, rtrim({PATH}, '/') AS path, contains(url, 'utm_source') AS is_index FROM pages)
SELECT page_id FROM p WHERE NOT EXISTS (SELECT 1 FROM p s WHERE s.is_index AND s.site = p.site AND s.path = p.path)""")
def section_listing_antijoin(spark, sf_dir):
    """Pages that aren't the index of a section of their site."""
    p = pages(spark, sf_dir).select("page_id", urls.host(F.col("url")).alias("site"), urls.bare_path(F.col("url")).alias("path"), F.col("url").contains("utm_source").alias("is_index"))
    return discover.listing_filter(p, p.where("is_index").select("site", "path"), F.col("path")).select("page_id")


@query(f"""SELECT page_id, (NOT regexp_matches(lower(p), '\\.({'|'.join(urls.BINARY)})$') AND NOT regexp_matches(lower(p), '(^|/)({'|'.join(urls.NOT_ARTICLE)})(/|$)') AND len(list_filter(string_split(p, '/'), lambda x: x <> '')) >= 2) AS usable,
 (regexp_matches(lower(p), '/article/') OR regexp_matches(p, '/[0-9]{{4}}/')) AS article_like,
 (regexp_matches(lower(rtrim(p, '/')), '/page/[0-9]+$') OR regexp_matches(q, '(^|&)(page|paged|pg)=[0-9]+') OR regexp_matches(lower(rtrim(p, '/')), '({'|'.join(urls.LISTING)})$')) AS listing_like
FROM (SELECT page_id, {PATH} AS p, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages)""")
def usable_url_filter(spark, sf_dir):
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", urls.is_usable(u).alias("usable"), urls.is_article_like(u).alias("article_like"), urls.is_listing_like(u).alias("listing_like"))


@query(f"""SELECT page_id, CAST((CASE WHEN regexp_matches(p, '\\b[0-9]{{4}}\\b') THEN 25 ELSE 0 END) + (CASE WHEN regexp_matches(p, '\\b[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}\\b') THEN 20 ELSE 0 END) + (CASE WHEN n BETWEEN 3 AND 9 THEN 8 ELSE 0 END) AS INTEGER) AS score, CAST(n AS INTEGER) AS n_segments
FROM (SELECT page_id, {PATH} || '/2024/' || (page_id % 14) AS p, len(list_filter(string_split({PATH} || '/2024/' || (page_id % 14), '/'), lambda x: x <> '')) AS n FROM pages)""")
def path_score_segments(spark, sf_dir):
    longer = F.concat(urls.origin(F.col("url")), urls.path(F.col("url")), F.lit("/2024/"), (F.col("page_id") % 14).cast("string"))
    return pages(spark, sf_dir).select("page_id", urls.path_score(longer).alias("score"), F.size(urls.segments(longer)).alias("n_segments"))


@query("SELECT page_id, CASE WHEN regexp_extract(url, '[?&]page=([0-9]+)', 1) <> '' THEN CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS INTEGER) END AS page FROM pages")
def page_number(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.page_number(F.col("url")).alias("page"))


@query(f"SELECT page_id, string_split({HOST}, '.')[-2] AS site, CASE WHEN s = '' THEN 'index' ELSE s END AS section FROM (SELECT page_id, url, regexp_replace(coalesce(list_filter(string_split({PATH}, '/'), lambda x: x <> '')[-1], ''), '\\.[A-Za-z0-9]+$', '') AS s FROM pages)")
def site_section_ids(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.site_id(F.col("url")).alias("site"), urls.section_id(F.col("url")).alias("section"))


@query("SELECT page_id, left(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), 200) AS title FROM pages")
def title_fallback(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", text.page_title(F.col("html")).alias("title"))


@query("SELECT page_id, length(h) AS n, sha1(h) AS hash FROM (SELECT page_id, regexp_replace(html, '(?is)<style\\b[^>]*>.*?</style>', '', 'g') AS h FROM pages)")
def strip_styles(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", text.strip_styles(F.col("html")).alias("h")).select("page_id", F.length("h").cast("long").alias("n"), F.sha1("h").alias("hash"))


@query("SELECT page_id, length(html) >= 200 AND regexp_matches(lower(html), 'cf-chl|challenge-platform|cf-browser-verification|cf-challenge|__cf_chl_|just a moment') AS gate FROM (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN replace(html, '<article>', '<article>Just a Moment') ELSE html END AS html FROM pages)")
def bot_gate_flag(spark, sf_dir):
    marked = F.when(F.col("page_id") % 10 == 0, F.replace("html", F.lit("<article>"), F.lit("<article>Just a Moment"))).otherwise(F.col("html"))
    return pages(spark, sf_dir).select("page_id", text.is_bot_gate(marked).alias("gate"))


@query("SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'password=') AS paywalled, length(text) AS n FROM documents")
def paywall_filter(spark, sf_dir):
    """Texts that hold a marker, in any case; a list of markers, not a text, makes it work."""
    markers = F.array(F.lit("LICENSE"), F.lit("password="), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.has_marker(F.col("text"), markers).alias("paywalled"), F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, length(trim(text)) >= 200 AS body_good FROM documents")
def body_good_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.body_good(F.col("text")).alias("body_good"))


@query("SELECT doc_id, sha1(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS xml, sha1(replace(text || ']]>' || 'x', ']]>', ']]]]><![CDATA[>')) AS cdata FROM documents")
def xml_escape_cdata(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(text.escape_xml(t)).alias("xml"), F.sha1(text.cdata(F.concat(t, F.lit("]]>x")))).alias("cdata"))


@query("SELECT conv_id, turn, list_aggregate(list_transform(list_filter(list_transform(string_split_regex(text || chr(10) || chr(10) || role || chr(10) || '<&>', '\\n{2,}'), lambda b: trim(regexp_replace(b, '\\n+', ' ', 'g'))), lambda b: b <> ''), lambda b: '<p>' || replace(replace(replace(replace(b, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</p>'), 'string_agg', chr(10)) AS html FROM conversations")
def text_to_html(spark, sf_dir):
    t = F.concat("text", F.lit("\n\n"), "role", F.lit("\n<&>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.text_to_html(t).alias("html"))


@query("SELECT doc_id, sha1(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '\\*([^*\\n]+)\\*', '\\1', 'g'), '(?m)^#{1,6}\\s+', '', 'g'), '(?m)^>[ \\t]?', '', 'g'), '`([^`]+)`', '\\1', 'g')) AS plain FROM documents")
def markdown_strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(text.strip_markdown(F.col("text"))).alias("plain"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part")
def slugify_prettify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", urls.slugify(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"), urls.prettify(urls.slugify(F.col("p_name"))).alias("title"))


@query("""WITH RECURSIVE edges AS (SELECT DISTINCT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem UNION SELECT DISTINCT l_suppkey * 2 + 1, l_partkey * 2 FROM lineitem),
reach(url, level) AS (SELECT min(l_partkey) * 2, 0 FROM lineitem UNION SELECT dst, level + 1 FROM reach JOIN edges ON src = url WHERE level < 8),
seen AS (SELECT url, min(level) AS level FROM reach GROUP BY url)
SELECT url, CAST(level AS INTEGER) AS level FROM seen ORDER BY level, url LIMIT 40""")
def bfs_frontier(spark, sf_dir):
    """Forty nearest pages to the first part over all of a dense link table: parts are even pages, suppliers odd ones."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("part"), (F.col("l_suppkey") * 2 + 1).alias("supplier"))
    edges = lines.select("part", "supplier").union(lines.select("supplier", "part")).toDF("src", "dst").withColumn("site", F.lit("s"))
    seeds = lines.agg(F.min("part").alias("url")).where("url IS NOT NULL").withColumn("site", F.lit("s"))
    return discover.frontier(edges, seeds).select("url", "level")


@query("""WITH RECURSIVE edges AS (SELECT l_orderkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem UNION SELECT l_partkey * 2 + 1, l_orderkey * 2 FROM lineitem),
reach(url, level) AS (SELECT min(l_orderkey) * 2, 0 FROM lineitem UNION SELECT dst, level + 1 FROM reach JOIN edges ON src = url WHERE level < 8),
seen AS (SELECT url, min(level) AS level FROM reach GROUP BY url)
SELECT url, CAST(level AS INTEGER) AS level FROM seen ORDER BY level, url LIMIT 40""")
def bfs_frontier_links(spark, sf_dir):
    """Forty nearest pages to the first order over all of a link table, to the reference's depth: orders are even pages, parts odd ones."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("order"), (F.col("l_partkey") * 2 + 1).alias("part"))
    edges = lines.select("order", "part").union(lines.select("part", "order")).toDF("src", "dst").withColumn("site", F.lit("s"))
    seeds = lines.agg(F.min("order").alias("url")).where("url IS NOT NULL").withColumn("site", F.lit("s"))
    return discover.frontier(edges, seeds).select("url", "level")


def parsed_pages(spark, sf_dir):
    return pages(spark, sf_dir).withColumn("fields", html.page_fields(F.col("html"), F.col("url")))


def _plain(body: str) -> str:
    return f"trim(regexp_replace(replace(replace(replace(replace(regexp_replace({body}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"


ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"


@query(f"SELECT page_id, sha1({_plain(ARTICLE)}) AS text_hash, length({_plain(ARTICLE)}) >= 200 AS body_good, left({_plain('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')}, 200) AS title FROM pages")
def clean_article(spark, sf_dir):
    """The main text of each page from its tree; here the article element, as SQL sees it too."""
    return parsed_pages(spark, sf_dir).select("page_id", F.sha1("fields.content_text").alias("text_hash"), text.body_good(F.col("fields.content_text")).alias("body_good"), "fields.title")


@query("""SELECT page_id, CAST(i AS INTEGER) AS ord, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href AS url, href[2:] AS text
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS i FROM pages)""")
def page_anchors(spark, sf_dir):
    linked = pages(spark, sf_dir).withColumn("fields", html.page_links(F.col("html"), F.col("url")))
    links = discover.raw_candidates(linked).where("source = 'anchor'")
    return links.select("page_id", "ord", "url", F.col("title").alias("text"))


@query()
def page_fields(spark, sf_dir):
    """All fields of each page from one parse."""
    return parsed_pages(spark, sf_dir).select("page_id", "fields.text", "fields.title", "fields.metadata", F.size("fields.anchors").alias("n_anchors"), F.size("fields.records").alias("n_records"))


@query(f"""WITH n AS (SELECT page_id, {NORM} AS u, {HOST} AS site, html FROM pages), a AS (SELECT page_id, u AS url, site, {_plain(ARTICLE)} AS t FROM n),
f AS (SELECT *, row_number() OVER (PARTITION BY site, sha1(url) ORDER BY page_id) AS k FROM a)
SELECT site, sha1(url) AS hash, page_id, CAST(row_number() OVER (PARTITION BY site ORDER BY page_id DESC, sha1(url)) AS INTEGER) AS rank FROM f WHERE k = 1 AND length(t) >= 200 QUALIFY rank <= 10""")
def site_feed_topk(spark, sf_dir):
    """From fetched pages to every site's newest ten good articles; the number of a page stands for the time it was seen."""
    from presswork.streaming.ingest import parsed_articles

    seen = F.timestamp_millis(F.col("page_id") * 60_000)
    parsed = parsed_articles(pages(spark, sf_dir), urls.host(F.col("url")), seen).where("body_good")
    unique = items.first_rows(parsed, ["site", "hash"], "first_seen")
    top = feeds.top_items_per(unique, ["site"], 10)
    return top.select("site", "hash", (F.unix_millis("first_seen") / 60_000).cast("long").alias("page_id"), "rank")
