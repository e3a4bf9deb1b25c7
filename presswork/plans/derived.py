"""Queries over whole tables for functions whose input the tables lack: texts are made from the columns of every row, and SQL tells the result from those columns, not from the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.functions import dates, html, records, text, urls
from presswork.operators import batches, discover, feeds, items, quality
from presswork.plans.registry import query, table
from presswork.plans.web import NORM, pages
from presswork.sources import feeds as sources

PICTURES = "<picture><source srcset=\"x\"><img src=\"y\"></picture><div><figure><img src=\"z\"><figcaption>cap</figcaption></figure></div><section><div><span><IMG></span></div></section>"
_EMPTY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?i)<div\\b[^>]*>\\s*</div>', '', 'g'), '(?i)<section\\b[^>]*>\\s*</section>', '', 'g'), '(?i)<article\\b[^>]*>\\s*</article>', '', 'g'), '(?i)<span\\b[^>]*>\\s*</span>', '', 'g')"
_WITHOUT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<picture\\b[^>]*>.*?</picture>', '', 'g'), '(?i)<img\\b[^>]*>', '', 'g'), '(?is)<figcaption\\b[^>]*>.*?</figcaption>', '', 'g'), '(?i)<figure\\b[^>]*>\\s*</figure>', '', 'g')"
for _ in range(5):
    _WITHOUT = _EMPTY.format(_WITHOUT)


@query(f"SELECT page_id, sha1({_WITHOUT}) AS html FROM (SELECT page_id, replace(html, '<article>', '<article>' || '{PICTURES}') AS h FROM pages)")
def strip_images(spark, sf_dir):
    """Every page with pictures put into its article."""
    shown = F.replace("html", F.lit("<article>"), F.lit("<article>" + PICTURES))
    return pages(spark, sf_dir).select("page_id", F.sha1(text.strip_images(shown)).alias("html"))


@query("""SELECT p_partkey, regexp_full_match(id, '[a-z0-9-]{1,40}') AND id NOT IN ('health', 'opml', 'item', 'status') AS valid FROM (SELECT p_partkey,
 CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN replace(p_name, ' ', '-') WHEN 3 THEN repeat(replace(p_name, ' ', '-'), 6) ELSE CASE WHEN p_partkey % 2 = 0 THEN 'health' ELSE 'a' || p_partkey END END AS id FROM part)""")
def identifiers(spark, sf_dir):
    kebab, key = F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_partkey")
    odd = F.when(key % 2 == 0, "health").otherwise(F.concat(F.lit("a"), key.cast("string")))
    made = F.when(key % 5 == 0, F.col("p_name")).when(key % 5 == 1, F.col("p_brand")).when(key % 5 == 2, kebab).when(key % 5 == 3, F.repeat(kebab, F.lit(6))).otherwise(odd)
    return table(spark, sf_dir, "part").select("p_partkey", urls.is_identifier(made).alias("valid"))


def dated(orders, forms):
    """Each order's date written in one of the forms, by its key."""
    form = F.lit(None).cast("string")
    for i, make in enumerate(forms):
        form = F.when(F.col("o_orderkey") % len(forms) == i, make).otherwise(form)
    return orders.withColumn("made", form)


def written(pattern: str):
    return F.date_format("o_orderdate", pattern)


US, EU, ISO = "MMMM d, yyyy", "d MMM yyyy", "yyyy-M-d"
DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN {DAY} END AS iso, CASE WHEN o_orderkey % 5 < 3 THEN 'Prices of ' || o_orderpriority END AS rest FROM orders")
def leading_date(spark, sf_dir):
    """Titles that begin with the order's date in three forms, glued or not, and two that begin with none."""
    title = F.concat(F.lit("Prices of "), F.col("o_orderpriority"))
    forms = [F.concat(written(US), title), F.concat(written(EU), F.lit(" - "), title), F.concat(written(ISO), F.lit(": "), title), title, F.concat(F.lit("Level 5, 2026 "), title)]
    return dated(table(spark, sf_dir, "orders"), forms).withColumn("d", dates.leading_date(F.col("made"))).select("o_orderkey", "d.iso", "d.rest")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN {DAY} END AS iso, CASE o_orderkey % 6 WHEN 0 THEN 'Prices of goods' WHEN 1 THEN 'Prices of goods' WHEN 2 THEN 'Prices on ' || strftime(o_orderdate, '%B %-d, %Y') WHEN 3 THEN 'Prices of 2019'
 WHEN 4 THEN 'Prices, part 11' || strftime(o_orderdate, '%d %b %Y') END AS rest FROM orders""")
def trailing_date(spark, sf_dir):
    """Titles that end with the order's date: glued, before a reading time, as a part of the sentence, after a year, after a number that may belong to it; and none."""
    padded = written("dd MMM yyyy")
    forms = [
        F.concat(F.lit("Prices of goods"), written(EU)),
        F.concat(F.lit("Prices of goods - "), written(US), F.lit(" / 5 min read")),
        F.concat(F.lit("Prices on "), written(US)),
        F.concat(F.lit("Prices of 2019"), padded),
        F.concat(F.lit("Prices, part 11"), padded),
        F.lit("Prices without a date"),
    ]
    return dated(table(spark, sf_dir, "orders"), forms).withColumn("d", dates.trailing_date(F.col("made"))).select("o_orderkey", "d.iso", "d.rest")


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN {DAY} END AS iso FROM orders")
def path_date(spark, sf_dir):
    forms = [F.concat(F.lit("/en/news/"), written("yyyy/MM/dd"), F.lit("/x")), F.concat(F.lit("/"), written("yyyy/M/d"), F.lit("/")), F.concat(F.lit("/"), written("yyyy/'13'/dd"), F.lit("/x"))]
    return dated(table(spark, sf_dir, "orders"), forms).select("o_orderkey", dates.path_date(F.col("made")).alias("iso"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN o_orderdate + CASE WHEN o_orderkey % 6 IN (1, 2) THEN INTERVAL '10:11:12' HOUR TO SECOND ELSE INTERVAL 0 DAY END END AS ts FROM orders".replace("INTERVAL '10:11:12' HOUR TO SECOND", "INTERVAL 36672 SECOND"))
def parse_dates(spark, sf_dir):
    forms = [written("yyyy-MM-dd"), written("yyyy-MM-dd'T10:11:12Z'"), written("EEE, dd MMM yyyy '10:11:12 GMT'"), written(US), written("d MMMM yyyy"), F.lit("junk")]
    return dated(table(spark, sf_dir, "orders"), forms).select("o_orderkey", dates.parse_date(F.col("made")).alias("ts"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN event_type = 'view' ELSE code IN (403, 420, 429, 503, 529) END AS throttled, CASE event_id % 4 WHEN 0 THEN CAST(code AS VARCHAR) WHEN 1 THEN '404' WHEN 2 THEN CASE WHEN code BETWEEN 400 AND 599 THEN CAST(code AS VARCHAR) END END AS status
FROM (SELECT *, 395 + event_id % 211 AS code FROM events)""")
def throttle_classify(spark, sf_dir):
    """Error messages of every event: with an arrow, with two codes, with one, and in words."""
    code, key = (395 + F.col("event_id") % 211).cast("string"), F.col("event_id") % 4
    words = F.when(F.col("event_type") == "view", "Too Many Requests").otherwise("all fine")
    message = F.when(key == 0, F.concat(F.lit("plain fetch http://127.0.0.1:65292/a -> "), code)).when(key == 1, F.concat(F.lit("error "), code, F.lit(" then 404 seen"))).when(key == 2, F.concat(F.lit("code "), code)).otherwise(words)
    return table(spark, sf_dir, "events").select("event_id", text.is_throttle(message).alias("throttled"), text.status_of(message).alias("status"))


@query("""SELECT s_suppkey, CAST(least(a, b) AS BIGINT) AS low, CAST(greatest(a, b) AS BIGINT) AS high FROM (SELECT s_suppkey, CASE WHEN low > 0 THEN round(low * 1000) ELSE 0 END AS a, CASE WHEN high > 0 THEN round(high * 1000) ELSE 0 END AS b
 FROM (SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey - 5 END, 2) AS low, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey / 2 END, 5) AS high FROM supplier))""")
def delay_band(spark, sf_dir):
    low, high = F.when(F.col("s_suppkey") % 3 > 0, F.col("s_nationkey") - 5).cast("double"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey") / 2)
    return table(spark, sf_dir, "supplier").withColumn("d", text.delay_band(low, high, F.lit(2.0), F.lit(5.0))).select("s_suppkey", F.col("d.lower").alias("low"), F.col("d.upper").alias("high"))


@query("SELECT c_custkey, CAST(CASE c_custkey % 3 WHEN 0 THEN greatest(c_custkey % 70, 1) ELSE 15 END AS INTEGER) AS ttl FROM customer")
def ttl(spark, sf_dir):
    key = F.col("c_custkey")
    schedule = F.when(key % 3 == 0, F.concat(F.lit("*/"), (key % 70).cast("string"), F.lit(" * * * *"))).when(key % 3 == 1, F.concat(F.lit("0 */"), (key % 9).cast("string"), F.lit(" * * *"))).otherwise("x")
    return table(spark, sf_dir, "customer").select("c_custkey", dates.ttl_minutes(schedule).alias("ttl"))


@query("""SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE WHEN 1 THEN time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') + INTERVAL 6 HOUR
 WHEN 2 THEN m + CASE WHEN extract(hour FROM ts) * 60 + extract(minute FROM ts) >= 195 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END + INTERVAL 195 MINUTE WHEN 3 THEN date_trunc('month', ts) + INTERVAL 1 MONTH ELSE date_trunc('week', ts) + INTERVAL 7 DAY END AS TIMESTAMP) AS next FROM (SELECT *, date_trunc('day', ts) AS m FROM events)""")
def next_cron_run(spark, sf_dir):
    """The next run after every event, by half hours, six hours, days, months or weeks."""
    schedules = F.array(*map(F.lit, ["*/30 * * * *", "0 */6 * * *", "15 3 * * *", "0 0 1 * *", "0 0 * * 1"]))
    return table(spark, sf_dir, "events").select("event_id", dates.next_cron_run(F.get(schedules, (F.col("event_id") % 5).cast("int")), F.col("ts")).alias("next"))


@query("SELECT o_orderkey AS ord, 'https://a.example/' || CASE WHEN o_orderkey % 2 = 0 THEN 'r/' ELSE '' END || o_orderkey AS url, 'A & ' || o_orderpriority AS title, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS published FROM orders WHERE o_orderkey % 7 > 0")
def atom_items(spark, sf_dir):
    """An entry for every order: half of them behind a redirect, a seventh without a web address, which go."""
    key = F.col("o_orderkey")
    link = F.when(key % 7 == 0, F.lit("ftp://a.example/x")).when(key % 2 == 0, F.concat(F.lit("https://news.example/r?url=https%3A%2F%2Fa.example%2Fr%2F"), key.cast("string"), F.lit("&ct=1"))).otherwise(F.concat(F.lit("https://a.example/"), key.cast("string")))
    entries = table(spark, sf_dir, "orders").select(key.alias("ord"), link.alias("link"), F.concat(F.lit("A &#38; <b>"), "o_orderpriority", F.lit("</b>")).alias("title"), F.when(key % 3 > 0, F.col("o_orderdate")).alias("published"))
    return sources.atom_entries(entries)


HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"
ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
# Sightings of every link of every page, as an index page would have them: first as a bare link, then as a record with a title and, for every
# other one, a date. Two of three links are dated by their path.
SIGHTINGS = f"""(SELECT page_id, i, twice, o || CASE WHEN i % 3 < 2 THEN '/2024/05/0' || (i + 1) || href ELSE '/files' || href END AS address, CASE WHEN twice = 0 THEN 'Short' ELSE 'A headline with words enough about ' || href[2:] END AS title,
 CASE WHEN twice = 1 AND i % 2 = 0 THEN '2020-01-01' END AS given, i % 3 < 2 AS in_path FROM (SELECT page_id, {ORIGIN} AS o, unnest({HREFS}) AS href, unnest(range(len({HREFS}))) AS i FROM pages), (SELECT unnest([0, 1]) AS twice))"""


def sightings(spark, sf_dir):
    found = pages(spark, sf_dir).select("page_id", urls.origin(F.col("url")).alias("o"), F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("i", "href"))
    twice = found.withColumn("twice", F.explode(F.array(F.lit(0), F.lit(1))))
    path = F.when(F.col("i") % 3 < 2, F.concat(F.lit("/2024/05/0"), (F.col("i") + 1).cast("string"))).otherwise("/files")
    title = F.when(F.col("twice") == 0, "Short").otherwise(F.concat(F.lit("A headline with words enough about "), F.substring("href", 2, 1000)))
    return twice.select(
        "page_id",
        F.concat("o", F.lit("/")).alias("index_url"),
        (F.col("twice") * 100 + F.col("i")).alias("ord"),
        F.concat("o", path, "href").alias("url"),
        title.alias("title"),
        F.when((F.col("twice") == 1) & (F.col("i") % 2 == 0), "2020-01-01").alias("date"),
        F.when(F.col("twice") == 0, "anchor").otherwise("json").alias("source"),
    )


# The path of a dated link scores 53, is accepted at once, and keeps the date of its path; the others come in with the record's title.
_SCORED = f"""SELECT page_id, address AS url, CASE WHEN in_path THEN 'Short' ELSE title END AS title, CASE WHEN in_path THEN '2024-05-0' || (i + 1) ELSE given END AS date, CASE WHEN in_path THEN 'anchor' ELSE 'json' END AS source,
 CASE WHEN in_path THEN 53 + 20 + 15 + 12 ELSE 20 + 12 + CASE WHEN given IS NULL THEN 0 ELSE 15 END END AS score, CASE WHEN in_path THEN i ELSE 100 + i END AS ord FROM {SIGHTINGS} WHERE twice = 1"""
_MERGED = f"SELECT page_id, url, arg_min(title, ord) AS title, arg_min(date, ord) FILTER (WHERE date IS NOT NULL) AS date, arg_min(source, ord) AS source, max(score) AS score, min(ord) AS ord FROM ({_SCORED}) GROUP BY page_id, url"


@query(f"SELECT page_id, url, title, date, source, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) AS INTEGER) AS rank FROM ({_MERGED})")
def candidate_score_merge(spark, sf_dir):
    """All links of all pages, scored and merged."""
    merged = discover.merge_candidates(discover.score_candidates(sightings(spark, sf_dir)))
    return merged.select("page_id", "url", "title", "date", "source", "score", "rank")


@query(f"SELECT site, url, CAST(page_id AS BIGINT) AS page_id, title, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, page_id, ord, url) AS rank FROM (SELECT m.*, {ORIGIN.replace('url', 'p.url')} AS site FROM ({_MERGED}) m JOIN pages p USING (page_id) QUALIFY row_number() OVER (PARTITION BY site, m.url ORDER BY page_id) = 1)) WHERE rank <= 100")
def candidate_page_merge(spark, sf_dir):
    """Candidates of all pages of a site: the first page that has an address wins."""
    merged = discover.merge_candidates(discover.score_candidates(sightings(spark, sf_dir))).withColumn("site", urls.origin(F.col("url")))
    return discover.merge_pages(merged, "site").select("site", "url", "page_id", "title", "rank")


@query(f"SELECT page_id, CASE WHEN j > 0 AND j >= a THEN 'embedded-json' ELSE 'anchors' END AS mode FROM (SELECT page_id, count(*) FILTER (WHERE source = 'json') AS j, count(*) FILTER (WHERE source = 'anchor') AS a FROM (SELECT * FROM ({_MERGED}) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) <= 30) GROUP BY page_id)")
def detect_mode(spark, sf_dir):
    return discover.detect_mode(discover.merge_candidates(discover.score_candidates(sightings(spark, sf_dir))))


@query(f"""WITH l AS (SELECT page_id, {ORIGIN} AS o, unnest({HREFS}) AS href, unnest(range(len({HREFS}))) AS i FROM pages),
k AS (SELECT page_id, i, CASE i % 4 WHEN 0 THEN o || '/markets/list?page=' || (2 + i // 2) WHEN 1 THEN o || '/markets/' || i ELSE o || '/sports/news' END AS url, CASE WHEN i % 4 = 0 THEN 'next' WHEN i % 2 = 1 THEN 'All news of ' || href[2:] ELSE 'x' END AS label FROM l)
SELECT page_id, url, left(label, 40) AS label, CAST(i AS INTEGER) AS ord FROM k WHERE (i = 0 AND false) OR i % 4 = 1 OR (i % 4 = 0 AND 2 + i // 2 = 3)""")
def follow_links(spark, sf_dir):
    """Links of every page to further listings of the second page of its section."""
    found = pages(spark, sf_dir).select("page_id", urls.origin(F.col("url")).alias("o"), F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("ord", "href"))
    i = F.col("ord")
    url = F.when(i % 4 == 0, F.concat(F.col("o"), F.lit("/markets/list?page="), (2 + F.floor(i / 2)).cast("string"))).when(i % 4 == 1, F.concat(F.col("o"), F.lit("/markets/"), i.cast("string"))).otherwise(F.concat(F.col("o"), F.lit("/sports/news")))
    label = F.when(i % 4 == 0, "next").when(i % 2 == 1, F.concat(F.lit("All news of "), F.substring("href", 2, 1000))).otherwise("x")
    return discover.follow_links(found.select("page_id", F.concat("o", F.lit("/markets/list?page=2")).alias("index_url"), "ord", url.alias("url"), label.alias("title")))


LD = '<script type="application/ld+json">{{"@graph":[{{"@type":"WebPage","name":"w"}},{{"@type":"NewsArticle","headline":"H {0}","datePublished":"2026-01-02","author":[{{"name":"Ann {0}"}},{{"name":"Bo"}}],"image":{{"url":"https://e/{0}.png"}}}}]}}</script>'
OG = '<meta property="og:title" content="OG {0}"><meta name="twitter:creator" content="@t{0}"><meta property="article:published_time" content="2026-03-04">'
HEADS = [LD, OG, '<script type="application/ld+json">{{bad {0}</script>', LD + OG]


def _with_id(form: str):
    """The form with each row's page_id for its mark."""
    return F.replace(F.lit(form.format("PAGE")), F.lit("PAGE"), F.col("page_id").cast("string"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'OG ' || page_id WHEN 2 THEN NULL ELSE 'H ' || page_id END AS title, CASE page_id % 4 WHEN 1 THEN '@t' || page_id WHEN 2 THEN NULL ELSE 'Ann ' || page_id END AS author,
 CASE page_id % 4 WHEN 1 THEN '2026-03-04' WHEN 2 THEN '2026-05-06' ELSE '2026-01-02' END AS date, CASE WHEN page_id % 4 IN (0, 3) THEN 'https://e/' || page_id || '.png' END AS image FROM pages""")
def page_metadata(spark, sf_dir):
    """Every page with one of four kinds of metadata in its head, and a time in its body."""
    head = F.lit(None).cast("string")
    for i, form in enumerate(HEADS):
        head = F.when(F.col("page_id") % 4 == i, _with_id(form)).otherwise(head)
    told = F.replace(F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), head)), F.lit("<article>"), F.lit('<article><time datetime="2026-05-06">May</time>'))
    given = pages(spark, sf_dir).withColumn("f", html.page_fields(told, F.col("url")))
    return given.select("page_id", "f.metadata.title", "f.metadata.author", F.col("f.metadata.publishedAt").alias("date"), "f.metadata.image")


GOOD_JSON = '<script type="application/json">{{"items":[{{"url":"/a/{0}","headline":"T {0}","pubDate":"2026"}},{{"x":{{"uri":"/c/{0}","title":"U"}}}},{{"url":"https://other.com/z"}}]}}</script>'
BAD_JSON = '<script type="application/json">{{"url":"\\/e\\/{0}", bad</script>'


@query(f"""SELECT page_id, {ORIGIN} || '/a/' || page_id AS url, 'T ' || page_id AS title, '2026' AS date, 'json' AS source FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, {ORIGIN} || '/c/' || page_id, 'U', NULL, 'json' FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, {ORIGIN} || '/e/' || page_id, NULL, NULL, 'uri-regex' FROM pages WHERE page_id % 2 = 1""")
def embedded_json(spark, sf_dir):
    """Every page with a script of records, every other one of which isn't JSON."""
    script = F.when(F.col("page_id") % 2 == 0, _with_id(GOOD_JSON)).otherwise(_with_id(BAD_JSON))
    given = pages(spark, sf_dir).withColumn("fields", html.page_links(F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), script)), F.col("url")))
    return discover.raw_candidates(given).where("source <> 'anchor'").select("page_id", "url", "title", "date", "source")


_CLEAN = "html"
for _tag in ("script", "style"):
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', '', 'g')"
_CLEAN = f"trim(regexp_replace(regexp_replace(replace(replace(replace({_CLEAN}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"
UNSAFE = '<p onclick="go()"><a HREF="javascript:x" onMouseOver=y>in</a><iframe src="z">frame</iframe><img src="/r.png" onerror="w"></p>'


@query(f"SELECT page_id, false AS has_handlers, false AS has_unsafe, sha1('in' || {_CLEAN}) AS text_hash FROM pages")
def sanitized_pages(spark, sf_dir):
    """Every page with unsafe markup before it: that is gone, and all text of the page is still there."""
    clean = html.sanitize_html(F.concat(F.lit(UNSAFE), "html"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("h", "<[^>]*>", ""), r"\s+", " "))
    return pages(spark, sf_dir).select("page_id", clean.alias("h")).select("page_id", F.col("h").rlike(r"(?i)<[^>]*\son[a-z]+\s*=").alias("has_handlers"), F.col("h").rlike("(?i)<(script|iframe|style|meta)|javascript:|<img[^>]*src").alias("has_unsafe"), F.sha1(plain).alias("text_hash"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL WHEN trim(text) = '' THEN NULL ELSE role || ' ' || conv_id END AS title, CASE WHEN turn % 3 < 2 AND trim(text) <> '' THEN length(text) END AS n FROM conversations")
def llm_json_repair(spark, sf_dir):
    """A reply for every turn of every conversation: fenced, among prose, or none."""
    title = F.concat("role", F.lit(" "), F.col("conv_id").cast("string"))
    fenced = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(title.alias("headline"), F.col("text").alias("text"))), F.lit("\n```"))
    prose = F.concat(F.lit("Here it is. "), F.to_json(F.struct(title.alias("title"), F.col("text").alias("article_text"))), F.lit(" Bye."))
    reply = F.when(F.col("turn") % 3 == 0, fenced).when(F.col("turn") % 3 == 1, prose).otherwise("no json")
    given = table(spark, sf_dir, "conversations").withColumn("f", F.when(F.trim("text") != "", records.llm_fields(reply, F.lit("short"))))
    return given.select("conv_id", "turn", "f.title", F.length("f.text").cast("long").alias("n"))


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 ELSE 100 END AS INTEGER) AS max, CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS markers, c_custkey % 3 = 0 AS ignore_images FROM customer")
def site_config(spark, sf_dir):
    """Settings of every site; what can't be read, or a text in place of a list, falls back to the defaults."""
    key = F.col("c_custkey")
    good = F.concat(F.lit('{"extract":{"max":'), (key % 50).cast("string"), F.lit(',"ad_markers":["x","'), "c_name", F.lit('"]},"ignore_images":true}'))
    config = F.when(key % 3 == 0, good).when(key % 3 == 1, F.lit("{bad")).otherwise('{"extract":{"ad_markers":"x"}}')
    given = table(spark, sf_dir, "customer").withColumn("c", records.site_config(config))
    return given.select("c_custkey", F.coalesce("c.extract.max", F.lit(100)).alias("max"), F.coalesce(F.size(F.coalesce("c.extract.ad_markers", F.array().cast("array<string>"))), F.lit(0)).alias("markers"), F.coalesce("c.ignore_images", F.lit(False)).alias("ignore_images"))


@query(f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN {ORIGIN} || '/y' WHEN 1 THEN {ORIGIN} || '/z' ELSE url END AS chosen FROM pages")
def canonical_choice(spark, sf_dir):
    """Every page with a canonical and an own address, of its origin or of another."""
    key, own = F.col("page_id") % 4, urls.origin(F.col("url"))
    canonical = F.when(key == 0, F.concat(own, F.lit("/y"))).when(key < 3, F.lit("https://other.example/y"))
    og = F.when(key == 1, F.concat(own, F.lit("/z"))).when(key == 2, F.lit("https://other.example/z"))
    same = lambda a, b: urls.origin(a) == urls.origin(b)
    return pages(spark, sf_dir).select("page_id", feeds.canonical_url(F.col("url"), canonical, og, same).alias("chosen"))


@query("SELECT event_id, regexp_replace(event_type || CASE event_id % 3 WHEN 0 THEN '.xml' WHEN 1 THEN '.html' ELSE '.txt' END, '\\.(xml|html)$', '') AS route FROM events")
def route_names(spark, sf_dir):
    end = F.get(F.array(*map(F.lit, [".xml", ".html", ".txt"])), (F.col("event_id") % 3).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", urls.strip_extension(F.concat("event_type", end)).alias("route"))


@query("SELECT doc_id, length(left(text, 40)) AS label, length(left(text, 90)) AS link, length(left(text, 200)) AS title, length(left(text, 2000)) AS excerpt, length(left(text, 6000)) AS snapshot, length(left(text, 40000)) AS prompt FROM documents")
def truncations(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *(F.length(text.cut(F.col("text"), kind)).cast("long").alias(kind) for kind in text.CUTS))


# A batch of all pages. Every eleventh is empty, every thirteenth a challenge page, every seventh names a canonical address that all of its kind on one
# site share, every fifth is behind a paywall. The store knows the pages of .org sites, by their address with a slash; /en/1xx are sections.
GATE = "x" * 200 + "Just a moment"
BATCH_SQL = f"""(SELECT page_id, site, u, CASE WHEN regexp_matches(path, '^/en/1[0-9]*$') THEN 'listing' WHEN ends_with(site, '.org') THEN 'known' WHEN page_id % 11 = 0 OR page_id % 13 = 0 THEN 'failed' WHEN page_id % 5 = 0 THEN 'paywalled' END AS early, page_id % 13 = 0 AND page_id % 11 > 0 AS gate,
 CASE WHEN page_id % 7 = 0 THEN o || '/shared' ELSE u END AS own FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS site, {NORM} AS u, {ORIGIN} AS o, rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS path FROM pages))"""
OUTCOME_SQL = f"""(SELECT *, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY early IS NULL, site, CASE WHEN early IS NULL THEN rtrim(own, '/') ELSE CAST(page_id AS VARCHAR) END ORDER BY page_id) > 1 THEN 'duplicate' ELSE 'new' END) AS outcome FROM {BATCH_SQL})"""


def batch(spark, sf_dir):
    key, own = F.col("page_id"), F.concat(urls.origin(F.col("url")), F.lit("/shared"))
    marked = F.when(key % 7 == 0, F.replace("html", F.lit("<head>"), F.concat(F.lit('<head><link rel="canonical" href="'), own, F.lit('">')))).otherwise(F.col("html"))
    marked = F.when(key % 5 == 0, F.replace(marked, F.lit("<article>"), F.lit("<article><p>For Members Only</p>"))).otherwise(marked)
    page = F.when(key % 11 == 0, F.lit(None).cast("string")).when(key % 13 == 0, F.lit(GATE)).otherwise(marked)
    all_ = pages(spark, sf_dir)
    site = urls.host(F.col("url"))
    seen = all_.withColumn("html", page).select("*", site.alias("site"), F.lit("news").alias("section"), F.timestamp_millis(key * 60_000).alias("first_seen"))
    twin = F.concat(F.regexp_replace(urls.normalize_url(F.col("url")), "/+$", ""), F.lit("/"))
    stored = all_.where(site.endswith(".org")).select(site.alias("site"), twin.alias("url"), F.sha1(twin).alias("hash"))
    sections = all_.where(urls.bare_path(F.col("url")).rlike("^/en/1[0-9]*$")).select(site.alias("site"), F.col("url").alias("index_url"))
    sites = all_.select(site.alias("site")).distinct().withColumn("config_json", F.lit('{"extract":{"paywall_markers":["members only"]}}'))
    return batches.judge(seen, batches.known_keys(stored), sections, sites)


# On one site a listing's path hides all pages of that path.
@query(f"SELECT page_id, outcome, outcome = 'failed' AND gate AS retry FROM {OUTCOME_SQL}")
def ingest_outcomes(spark, sf_dir):
    """What becomes of every page of a batch against a store."""
    return batch(spark, sf_dir).select("page_id", "outcome", "retry")


@query(f"""SELECT site, count(*) AS discovered, count(*) FILTER (WHERE outcome = 'new') AS new_items, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'paywalled') AS paywalled, count(*) FILTER (WHERE outcome IN ('listing', 'known')) AS skipped,
 CASE WHEN count(*) FILTER (WHERE outcome = 'failed') > 0 THEN 'partial' ELSE 'ok' END AS status, arg_min('parse ' || u || ': ' || CASE WHEN page_id % 11 = 0 THEN 'the page is empty' ELSE 'no article on the page' END, page_id) FILTER (WHERE outcome = 'failed') AS error FROM {OUTCOME_SQL} GROUP BY site""")
def ingest_runs(spark, sf_dir):
    """The run of every site: counters, status and first error."""
    return batches.run_rows(batch(spark, sf_dir)).select("site", "discovered", "new_items", "failed", "paywalled", "skipped", "status", "error")


@query(f"SELECT DISTINCT site, 'news' AS section, first(sha1(own)) OVER (PARTITION BY site, rtrim(own, '/') ORDER BY page_id) AS hash FROM {OUTCOME_SQL} WHERE outcome IN ('new', 'duplicate')")
def ingest_memberships(spark, sf_dir):
    """Memberships of all articles of the batch, one for each address and its twin."""
    return batches.memberships(batch(spark, sf_dir)).select("site", "section", "hash")


@query(f"SELECT site, u AS url, page_id, gate AS retry FROM {OUTCOME_SQL} WHERE outcome = 'failed'")
def ingest_failures(spark, sf_dir):
    """Pages without an article, and which of them another engine is to get."""
    return batches.failures(batch(spark, sf_dir)).select("site", "url", "page_id", "retry")


@query("SELECT user_id AS site, count(*) FILTER (WHERE event_type <> 'error') AS finished, count(*) FILTER (WHERE event_type = 'error') AS unfinished FROM events GROUP BY user_id")
def unfinished_runs(spark, sf_dir):
    """Runs that have begun and not ended."""
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.when(F.col("event_type") != "error", F.col("ts")).alias("finished_at"))
    return quality.run_counts(runs)


@query("""SELECT s_suppkey AS site, s_name AS title, ts AS last_scrape_at, event_type AS last_scrape_status, props AS last_error FROM supplier
LEFT JOIN (SELECT * FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) ON user_id = s_suppkey""")
def site_listing(spark, sf_dir):
    """Sites with how their last run ended, views being runs that haven't."""
    ended = F.when(F.col("event_type") != "view", F.col("ts"))
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.col("event_id").alias("id"), ended.alias("finished_at"), F.col("event_type").alias("status"), F.col("props").alias("error"))
    return feeds.site_listing(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_name").alias("title")), runs)


@query("SELECT user_id AS site, event_type AS key, props AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def kv_values(spark, sf_dir):
    """The last value of every key, as the store's key values are read."""
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.col("event_type").alias("key"), F.col("props").alias("value"), "event_id")
    return items.latest_values(changes, ["site", "key"], "value", "event_id")
