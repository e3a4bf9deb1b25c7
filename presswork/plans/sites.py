"""Queries of sites: templates as table functions, fetching by host, crawls over listings, unique names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from presswork.functions import urls
from presswork.operators import discover, embedded, feeds, names
from presswork.plans.derived import _with_id, GATE, GOOD_JSON, HREFS, ORIGIN
from presswork.plans.registry import query, table
from presswork.plans.web import HOST, pages
from presswork.session import shared_dir
from presswork.sources import pages as fetched
from presswork.sources import templates

_LINKS = f"(SELECT page_id, {ORIGIN} AS o, unnest({HREFS}) AS href, unnest(range(len({HREFS}))) AS i FROM pages)"
_RECORD = f"SELECT page_id, CAST(CASE page_id % 3 WHEN 0 THEN len({HREFS}) ELSE 0 END + {{n}} AS INTEGER) AS ord, {ORIGIN} || '/{{path}}/' || page_id AS url, {{title}} AS title, {{date}} AS date, 'json' AS source FROM pages WHERE page_id % 3 <> 1"


@query(f"""SELECT page_id, CAST(i AS INTEGER) AS ord, o || href AS url, href[2:] AS title, NULL AS date, 'anchor' AS source FROM {_LINKS} WHERE page_id % 3 < 2
UNION ALL {_RECORD.format(n=0, path='a', title="'T ' || page_id", date="'2026'")} UNION ALL {_RECORD.format(n=1, path='c', title="'U'", date='NULL')}""")
def template_candidates(spark, sf_dir):
    """Candidates of every page by its site's template: links and records, links only, records only."""
    own = F.concat(urls.host(F.col("url")), F.lit("#"), F.col("page_id").cast("string"))
    told = pages(spark, sf_dir).withColumn("site", own).withColumn("html", F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), _with_id(GOOD_JSON))))
    template = F.get(F.array(*map(F.lit, ["generic", "anchors", "embedded_json"])), (F.col("page_id") % 3).cast("int"))
    return templates.of_sites(told, told.select("site", template.alias("template"))).select("page_id", "ord", "url", "title", "date", "source")


@query(f"""SELECT page_id, {HOST} AS host, CASE WHEN later THEN 'browser' ELSE 'plain' END AS engine, CASE WHEN later OR NOT bad THEN 'ok' WHEN page_id % 11 = 0 THEN 'failed' ELSE 'challenge' END AS outcome, CAST(CASE WHEN later THEN 2 ELSE 1 END AS INTEGER) AS attempts,
 CASE WHEN later OR NOT bad THEN sha1(html) WHEN page_id % 11 = 0 THEN sha1('') ELSE sha1('{GATE}') END AS hash FROM (SELECT *, page_id % 11 = 0 OR page_id % 13 = 0 AS bad, (page_id % 11 = 0 OR page_id % 13 = 0) AND page_id % 2 = 0 AS later FROM pages)""")
def fetched_pages(spark, sf_dir):
    """Every page as the engines give it: a plain one, which fails for some pages and gets a challenge for others, then a browser, which has half of those."""
    key, root = F.col("page_id"), shared_dir(spark)
    own = pages(spark, sf_dir)
    page = F.when(key % 11 == 0, F.lit("")).when(key % 13 == 0, F.lit(GATE)).otherwise(F.col("html"))
    fetched.keep_pages(own.withColumn("html", page), root)
    fetched.keep_pages(own.where((key % 2 == 0) & ((key % 11 == 0) | (key % 13 == 0))), root, "browser")
    return fetched.read_stored(spark, root, "plain,browser").select("page_id", "host", "engine", "outcome", "attempts", F.sha1("html").alias("hash"))


@query("""WITH l AS (SELECT l_suppkey AS site, l_partkey AS candidate, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) // 10 AS p FROM lineitem),
f AS (SELECT site, candidate, min(p) AS p FROM l GROUP BY ALL), g AS (SELECT site, p, count(*) AS gain FROM f GROUP BY ALL), q AS (SELECT DISTINCT site, p FROM l),
c AS (SELECT site, p, coalesce(gain, 0) AS gain, coalesce(sum(gain) OVER (PARTITION BY site ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM q LEFT JOIN g USING (site, p))
SELECT site, CAST(p AS BIGINT) AS place, CAST(gain AS BIGINT) AS gain FROM c WHERE had < 100 AND p < 40""")
def crawl_listings(spark, sf_dir):
    """The listings of every supplier, ten lines each and linked both ways, up to a hundred parts or forty listings."""
    # Lines of one order and number go by their place in the files, as it is however often they are read.
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "_metadata.file_path", "_metadata.row_index")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("candidate"), (F.row_number().over(order) - 1).alias("n"))
    found = lines.select("site", F.floor(F.col("n") / 10).alias("url"), (F.col("n") % 10).alias("ord"), "candidate")
    own = found.select("site", "url").distinct()
    links = own.select("site", F.col("url").alias("src"), F.posexplode(F.array(F.lit(0).cast("long"), F.col("url") - 1, F.col("url") + 1)).alias("ord", "dst")).join(own.select("site", F.col("url").alias("dst")), ["site", "dst"], "left_semi")
    read, merged = discover.crawl(links, found, own.where("url = 0"), to_the_end=True)
    gains = merged.groupBy("site", "place").agg(F.count("*").alias("gain"))
    return read.join(gains, ["site", "place"], "left").select("site", "place", F.coalesce("gain", F.lit(0)).alias("gain"))


_SERVED = "(SELECT *, o_custkey % 3 AS k, o_orderkey % 2 = 0 AS told FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 5)"


@query(f"""SELECT o_custkey AS site, o_orderkey AS hash, CASE WHEN k = 0 AND told THEN 'M ' || o_orderkey ELSE o_orderpriority END AS title, CASE WHEN k = 1 THEN '<p>' || o_orderpriority || '</p>' ELSE '<p>' || o_orderpriority || '</p><img src="x">' END AS content FROM {_SERVED}""")
def served_items(spark, sf_dir):
    """The five newest orders of every customer as they are served: settings prefer a model's fields for a third of the customers, and leave images out for another; the rest can't be read."""
    key = F.col("o_custkey")
    model = F.when(F.col("o_orderkey") % 2 == 0, F.struct(F.concat(F.lit("M "), F.col("o_orderkey").cast("string")).alias("title"), *(F.lit(None).cast("string").alias(x) for x in ("html", "text", "url", "publishedAt"))))
    body = F.concat(F.lit("<p>"), "o_orderpriority", F.lit('</p><img src="x">'))
    none = F.lit(None).cast("string")
    own = table(spark, sf_dir, "orders").select(key.alias("site"), F.col("o_orderkey").alias("hash"), F.col("o_orderdate").cast("timestamp").alias("published_at"), F.col("o_orderdate").cast("timestamp").alias("first_seen"), F.col("o_orderpriority").alias("title"), body.alias("content_html"), none.alias("url"), none.alias("text"), none.alias("author"), model.alias("llm"))
    top = feeds.top_items_per(own, ["site"], 5)
    config = F.when(key % 3 == 0, '{"extract":{"feedSource":"llm"}}').when(key % 3 == 1, '{"ignore_images":true,"extract":{"feedSource":"other"}}').otherwise("{bad")
    sites = table(spark, sf_dir, "orders").select(key.alias("site"), config.alias("config_json")).distinct()
    return feeds.feed_fields(feeds.with_settings(top, sites), F.col("prefer_model"), F.col("no_images")).select("site", "hash", "title", "content")


@query(f"""SELECT page_id, {ORIGIN} || rtrim(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/') AS index_url, CASE WHEN {HOST} LIKE '%.org' THEN s END AS site
FROM pages JOIN (SELECT {ORIGIN} AS o, min(page_id) AS s FROM pages GROUP BY ALL) ON o = {ORIGIN}""")
def listings_of_sites(spark, sf_dir):
    """Every page's address as a listing's, and the site that its origin belongs to; only .org sites are known."""
    own = pages(spark, sf_dir)
    known = own.where(urls.host(F.col("url")).endswith(".org")).select(F.col("page_id").alias("site"), "url")
    return discover.site_of(own, known).select("page_id", urls.index_url(F.col("url")).alias("index_url"), "site")


_DEEP = '{"headline":"T {0}","pubDate":" 2026 ","permalink":"/a/{0}","more":{"n":[1,"x",{"url":"","href":"//other.example/x"}]}}'


@query(f"""SELECT page_id, {ORIGIN} || '/a/' || page_id AS url, 'T ' || page_id AS title, '2026' AS date, 'json' AS source, CAST(page_id % 6 AS INTEGER) AS depth FROM pages WHERE page_id % 7 > 0
UNION ALL SELECT page_id, {ORIGIN} || '/b/' || page_id, NULL, NULL, 'uri-regex', 0 FROM pages WHERE page_id % 7 = 0""")
def embedded_nested(spark, sf_dir):
    """A record in a script of every page, up to five lists and objects deep; a seventh of the scripts isn't JSON."""
    key = F.col("page_id")
    record = F.replace(F.lit(_DEEP), F.lit("{0}"), key.cast("string"))
    for level in range(1, 6):
        wrapped = F.concat(F.lit('{"k":'), record, F.lit("}")) if level % 2 else F.concat(F.lit("[0,"), record, F.lit("]"))
        record = F.when(key % 6 >= level, wrapped).otherwise(record)
    script = F.concat(F.lit('<script id="x" type="application/json">'), F.when(key % 7 == 0, F.concat(F.lit('{"uri":"\\/b\\/'), key.cast("string"), F.lit('", bad'))).otherwise(record), F.lit("</script>"))
    given = pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), script)))
    return embedded.embedded_records(given).select("page_id", "url", "title", "date", "source", "depth")


_STEM = "lower(replace(p_brand, '#', '-'))"


@query(f"""WITH RECURSIVE q AS (SELECT p_partkey AS id, {_STEM} AS stem, {_STEM} || CASE p_partkey % 7 WHEN 3 THEN '-2' WHEN 5 THEN '-4' ELSE '' END AS base, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part),
r AS (SELECT stem, CAST(0 AS BIGINT) AS n, coalesce(list(DISTINCT stem || '-' || (3 + p_size % 5)) FILTER (WHERE p_partkey % 10 = 0), []) AS used, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS base, CAST(NULL AS VARCHAR) AS name FROM (SELECT *, {_STEM} AS stem FROM part) GROUP BY stem
UNION ALL SELECT stem, n, list_append(used, name), id, base, name FROM (SELECT r.stem, q.n, r.used, q.id, q.base, list_filter(list_transform(range(1, len(r.used) + 3), lambda i: CASE WHEN i = 1 THEN q.base ELSE q.base || '-' || i END), lambda x: NOT list_contains(r.used, x))[1] AS name FROM r JOIN q ON q.stem = r.stem AND q.n = r.n + 1))
SELECT id, base, name FROM r WHERE id IS NOT NULL""")
def unique_identifiers(spark, sf_dir):
    """An identifier for every part, of its brand and some with a number already, beside those that every tenth part has taken."""
    stem, key = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    base = F.concat(stem, F.when(key % 7 == 3, "-2").when(key % 7 == 5, "-4").otherwise(""))
    taken = parts.where(key % 10 == 0).select(F.concat(stem, F.lit("-"), (3 + F.col("p_size") % 5).cast("string")).alias("name"))
    return names.unique_names(parts.select(key.alias("id"), base.alias("base")), taken)
