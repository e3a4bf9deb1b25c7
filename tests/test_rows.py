"""Column functions and operators on rows written out here, each with what it has to give as SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from presswork.functions import dates, html, records, text, urls
from presswork.operators import discover, feeds
from presswork.sources import feeds as sources

CASES = {}


def query(sql):
    def register(f):
        CASES[f.__name__] = f, sql
        return f

    return register


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def values_sql(names, *values):
    def one(v):
        if v is None:
            return "NULL"
        return str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in values) + f") AS t({names}))"


IMAGES = [
    (1, "<p>a</p><picture><source srcset='x'><img src='y'></picture><p>b</p>"),
    (2, "<div><figure><img src='y'><figcaption>cap</figcaption></figure></div>t"),
    (3, "<section><div><span><img></span></div></section><figure><table></table></figure>"),
    (4, "plain <IMG SRC=x> text"),
]


_EMPTY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?i)<div\\b[^>]*>\\s*</div>', '', 'g'), '(?i)<section\\b[^>]*>\\s*</section>', '', 'g'), '(?i)<article\\b[^>]*>\\s*</article>', '', 'g'), '(?i)<span\\b[^>]*>\\s*</span>', '', 'g')"


_IMAGES_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<picture\\b[^>]*>.*?</picture>', '', 'g'), '(?i)<img\\b[^>]*>', '', 'g'), '(?is)<figcaption\\b[^>]*>.*?</figcaption>', '', 'g'), '(?i)<figure\\b[^>]*>\\s*</figure>', '', 'g')"


for _ in range(5):
    _IMAGES_SQL = _EMPTY.format(_IMAGES_SQL)


@query(f"SELECT id, {_IMAGES_SQL} AS html FROM {values_sql('id, html', *IMAGES)}")
def strip_images(spark, sf_dir):
    return rows(spark, "id int, html string", *IMAGES).select("id", text.strip_images(F.col("html")).alias("html"))


IDENTIFIERS = [("visa",), ("health",), ("Bad",), ("a-1",), ("x" * 41,), ("",), ("opml",)]


@query(f"SELECT id, regexp_full_match(id, '[a-z0-9-]{{1,40}}') AND id NOT IN ('health', 'opml', 'item', 'status') AS valid FROM {values_sql('id', *IDENTIFIERS)}")
def identifiers(spark, sf_dir):
    return rows(spark, "id string", *IDENTIFIERS).select("id", urls.is_identifier(F.col("id")).alias("valid"))


LEADING = [("March 9, 2021Harbour reopens", "2021-03-09", "Harbour reopens"), ("17 November 2019 | Rates", "2019-11-17", "Rates"), ("2022-2-7 – x", "2022-02-07", "x"), ("Route 66, 2020 x", None, None), ("Nothing dated", None, None), ("1 Jan 1960 x", None, None)]


TRAILING = [
    ("New bridge opens3 Mar 2021 / 4 min read / Local", "2021-03-03", "New bridge opens"),
    ("The storm of 12 October 2018", "2018-10-12", "The storm of 12 October 2018"),
    ("Plans for 201919 May 2018", "2018-05-19", "Plans for 2019"),
    ("Seen with K9X412 June 2020", "2020-06-12", "Seen with K9X4"),
    ("Chapter 1220 October 2021", "2021-10-20", "Chapter 1220 October 2021"),
    ("Old and new2020-01-02", "2020-01-02", "Old and new"),
    ("nothing", None, None),
]


PATHS = [("/en/news/articles/2026/05/21/x", "2026-05-21"), ("/2026/02/31/x", "2026-02-31"), ("/2026/13/01/x", None), ("/x", None), ("/1969/01/01/x", None)]


@query(f"SELECT title, iso, rest FROM {values_sql('title, iso, rest', *LEADING)}")
def leading_date(spark, sf_dir):
    return rows(spark, "title string", *((t,) for t, _, _ in LEADING)).withColumn("d", dates.leading_date(F.col("title"))).select("title", "d.iso", "d.rest")


@query(f"SELECT title, iso, rest FROM {values_sql('title, iso, rest', *TRAILING)}")
def trailing_date(spark, sf_dir):
    return rows(spark, "title string", *((t,) for t, _, _ in TRAILING)).withColumn("d", dates.trailing_date(F.col("title"))).select("title", "d.iso", "d.rest")


@query(f"SELECT path, iso FROM {values_sql('path, iso', *PATHS)}")
def path_date(spark, sf_dir):
    return rows(spark, "path string", *((p,) for p, _ in PATHS)).select("path", dates.path_date(F.col("path")).alias("iso"))


DATES = [("2026-08-05", "2026-08-05 00:00:00"), ("2026-08-05T10:11:12Z", "2026-08-05 10:11:12"), ("Wed, 05 Aug 2026 10:11:12 GMT", "2026-08-05 10:11:12"), ("August 5, 2026", "2026-08-05 00:00:00"), ("5 August 2026", "2026-08-05 00:00:00"), ("junk", None), ("", None)]


@query(f"SELECT raw, CAST(ts AS TIMESTAMP) AS ts FROM {values_sql('raw, ts', *DATES)}")
def parse_dates(spark, sf_dir):
    return rows(spark, "raw string", *((d,) for d, _ in DATES)).select("raw", dates.parse_date(F.col("raw")).alias("ts"))


MESSAGES = [("plain fetch http://127.0.0.1:65292/a -> 429",), ("error 503 then 404 seen",), ("Too Many Requests",), ("all fine",), ("code 200",), ("retry-after 3",)]


@query(f"""SELECT msg, regexp_matches(msg, '\\b(403|420|429|503|529)\\b') OR regexp_matches(lower(msg), 'rate.?limit|throttl|too many requests|retry[- ]after') AS throttled,
CASE WHEN regexp_extract(msg, '->\\s*([0-9]{{3}})\\s*$', 1) <> '' THEN regexp_extract(msg, '->\\s*([0-9]{{3}})\\s*$', 1) ELSE regexp_extract_all(msg, '\\b([45][0-9][0-9])\\b', 1)[-1] END AS status FROM {values_sql('msg', *MESSAGES)}""")
def throttle_classify(spark, sf_dir):
    return rows(spark, "msg string", *MESSAGES).select("msg", text.is_throttle(F.col("msg")).alias("throttled"), text.status_of(F.col("msg")).alias("status"))


BANDS = [(1, 5.0, 2.0, 2000, 5000), (2, None, None, 2000, 5000), (3, -1.0, 0.5, 0, 500), (4, None, 1.0, 1000, 2000)]


@query(f"SELECT id, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high FROM {values_sql('id, a, b, low, high', *BANDS)}")
def delay_band(spark, sf_dir):
    given = rows(spark, "id int, a double, b double", *(r[:3] for r in BANDS))
    return given.withColumn("d", text.delay_band(F.col("a"), F.col("b"), F.lit(2.0), F.lit(5.0))).select("id", F.col("d.lower").alias("low"), F.col("d.upper").alias("high"))


SCHEDULES = [("*/30 * * * *", 30), ("0 */6 * * *", 15), ("*/0 * * * *", 1), ("x", 15)]


@query(f"SELECT schedule, CAST(ttl AS INTEGER) AS ttl FROM {values_sql('schedule, ttl', *SCHEDULES)}")
def ttl(spark, sf_dir):
    return rows(spark, "schedule string", *((s,) for s, _ in SCHEDULES)).select("schedule", dates.ttl_minutes(F.col("schedule")).alias("ttl"))


CRON = [("*/30 * * * *", "2024-01-01 00:30:00"), ("0 */6 * * *", "2024-01-01 06:00:00"), ("15 3 * * 1", "2024-01-01 03:15:00"), ("0 0 13 * 5", "2024-01-05 00:00:00"), ("0 0 29 2 *", "2024-02-29 00:00:00"), ("1,2-3 * * * *", "2024-01-01 01:10:30"), ("5-10/5 1 * * 7", "2024-01-07 01:05:00")]


@query(f"SELECT schedule, CAST(next AS TIMESTAMP) AS next FROM {values_sql('schedule, next', *CRON)}")
def next_cron_run(spark, sf_dir):
    after = F.to_timestamp(F.lit("2024-01-01 00:10:30"))
    return rows(spark, "schedule string", *((s,) for s, _ in CRON)).select("schedule", dates.next_cron_run(F.col("schedule"), after).alias("next"))


ATOM = [(0, "https://news.example/r?url=https%3A%2F%2Fa.example%2Fx&ct=1", "A &#38; <b>B</b>", "2024-01-02 00:00:00"), (1, "ftp://x", "no", None), (2, "https://b.example/y", "B", None), (3, "https://c.example/z", "C", "2024-03-01 00:00:00")]


@query("SELECT * FROM (VALUES (3, 'https://c.example/z', 'C', TIMESTAMP '2024-03-01 00:00:00'), (0, 'https://a.example/x', 'A & B', TIMESTAMP '2024-01-02 00:00:00'), (2, 'https://b.example/y', 'B', NULL)) AS t(ord, url, title, published)")
def atom_items(spark, sf_dir):
    return sources.atom_entries(rows(spark, "ord int, link string, title string, published string", *ATOM))


INDEX = "https://ex.com/news/"


RAW = [
    (1, INDEX, 0, "https://ex.com/a/b", "short", None, "anchor"),
    (1, INDEX, 1, "https://ex.com/a/b?utm_source=x", "A headline that is long enough to count", None, "anchor"),
    (1, INDEX, 2, "https://ex.com/2026/08/12/slug", "August 5, 2026 Another headline of good length", None, "anchor"),
    (1, INDEX, 3, "https://ex.com/a/b", "Other title", "2026-01-01", "json"),
    (1, INDEX, 4, "https://ex.com/tag/x", "A headline that is long enough to count", None, "anchor"),
    (1, INDEX, 5, "https://other.com/c/d", "A headline that is long enough to count", None, "anchor"),
    (1, INDEX, 6, "https://ex.com/files/doc.pdf", "A headline that is long enough to count", None, "anchor"),
    (1, INDEX, 7, "https://ex.com/news?page=2", "Next", None, "anchor"),
    (2, INDEX, 0, "https://ex.com/x/y/z", None, "2026-02-02", "json"),
    (2, INDEX, 1, "https://ex.com/x/y/z", "Filled later", None, "uri-regex"),
]


_RAW_SCHEMA = "page_id int, index_url string, ord int, url string, title string, date string, source string"


MERGED = [
    (1, "https://ex.com/2026/08/12/slug", "Another headline of good length", "2026-08-12", "anchor", 93, 1),
    (1, "https://ex.com/a/b", "A headline that is long enough to count", "2026-01-01", "anchor", 27, 2),
    (2, "https://ex.com/x/y/z", "Filled later", "2026-02-02", "json", 35, 1),
]


@query(f"SELECT CAST(page_id AS INTEGER) AS page_id, url, title, date, source, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM {values_sql('page_id, url, title, date, source, score, rank', *MERGED)}")
def candidate_score_merge(spark, sf_dir):
    merged = discover.merge_candidates(discover.score_candidates(rows(spark, _RAW_SCHEMA, *RAW)))
    return merged.select("page_id", "url", "title", "date", "source", "score", "rank")


@query("SELECT * FROM (VALUES (1, 'anchors'), (2, 'embedded-json')) AS t(page_id, mode)")
def detect_mode(spark, sf_dir):
    return discover.detect_mode(discover.merge_candidates(discover.score_candidates(rows(spark, _RAW_SCHEMA, *RAW))))


FOLLOW = [
    (1, "https://ex.com/markets/list?page=2", 0, "https://ex.com/markets/list?page=3", "3"),
    (1, "https://ex.com/markets/list?page=2", 1, "https://ex.com/markets/list?page=61", "last"),
    (1, "https://ex.com/markets/list?page=2", 2, "https://ex.com/markets/news", "News"),
    (1, "https://ex.com/markets/list?page=2", 3, "https://ex.com/sports/news", "News"),
    (1, "https://ex.com/markets/list?page=2", 4, "https://ex.com/markets/a/deep/slug", "x / News"),
    (1, "https://ex.com/markets/list?page=2", 5, "https://ex.com/markets/more-here", "View all"),
    (1, "https://ex.com/markets/list?page=2", 6, "https://ex.com/markets/2024/01/02/x", "News"),
]


@query("SELECT * FROM (VALUES (1, 'https://ex.com/markets/list?page=3', '3', 0), (1, 'https://ex.com/markets/news', 'News', 2), (1, 'https://ex.com/markets/more-here', 'View all', 5)) AS t(page_id, url, label, ord)")
def follow_links(spark, sf_dir):
    return discover.follow_links(rows(spark, "page_id int, index_url string, ord int, url string, title string", *FOLLOW))


META = [
    (1, '<html><head><script type="application/ld+json">{"@type":"BreadcrumbList","name":"crumb"}</script><script type="application/ld+json">{"@graph":[{"@type":"WebPage","name":"w"},{"@type":"NewsArticle","headline":"H","datePublished":"2026-01-02","author":[{"name":"Ann"},{"name":"Bo"}],"image":{"url":"https://e/i.png"}}]}</script></head><body>x</body></html>', "H", "Ann", "2026-01-02", "https://e/i.png"),
    (2, '<html><head><meta property="og:title" content="OG"><meta name="twitter:creator" content="@t"><meta property="article:published_time" content="2026-03-04"></head><body>x</body></html>', "OG", "@t", "2026-03-04", None),
    (3, '<html><body><time datetime="2026-05-06">May</time>x</body></html>', None, None, "2026-05-06", None),
    (4, "<html><body><p>By X, July 28, 2026</p></body></html>", None, None, "July 28, 2026", None),
    (5, '<html><head><script type="application/ld+json">{bad</script></head><body>y</body></html>', None, None, None, None),
]


@query(f"SELECT CAST(id AS INTEGER) AS id, title, author, date, image FROM {values_sql('id, title, author, date, image', *((r[0], *r[2:]) for r in META))}")
def page_metadata(spark, sf_dir):
    given = rows(spark, "id int, html string", *(r[:2] for r in META)).withColumn("f", html.page_fields(F.col("html"), F.lit("https://e/")))
    return given.select("id", "f.metadata.title", "f.metadata.author", F.col("f.metadata.publishedAt").alias("date"), "f.metadata.image")


RECORDS = [
    (1, '<script type="application/json">{"items":[{"url":"/a/b","headline":"T","pubDate":"2026"},{"x":{"uri":"https://ex.com/c/d","title":"U"}},{"url":"https://other.com/z"}]}</script>'),
    (2, '<script type="application/json">{"url":"https:\\/\\/ex.com\\/e\\/f", bad</script>'),
]


@query("SELECT * FROM (VALUES (1, 'https://ex.com/a/b', 'T', '2026', 'json'), (1, 'https://ex.com/c/d', 'U', NULL, 'json'), (2, 'https://ex.com/e/f', NULL, NULL, 'uri-regex')) AS t(page_id, url, title, date, source)")
def embedded_json(spark, sf_dir):
    given = rows(spark, "page_id int, html string", *RECORDS).withColumn("url", F.lit(INDEX)).withColumn("fields", html.page_fields(F.col("html"), F.col("url")))
    return discover.raw_candidates(given).select("page_id", "url", "title", "date", "source")


REPLIES = [
    (1, 'Sure:\n```json\n{"headline": "T", "body": "' + "x" * 160 + '"}\n```', 2000, "T", 160),
    (2, '{"title": "A\nB", "html": "<p>..</p>"} trailing', 10, "A\nB", 2),
    (3, '{"title": "T", "html": "..."}', 1500, None, None),
    (4, "no json", 10, None, None),
    (5, "{}", 10, None, None),
]


@query(f"SELECT CAST(id AS INTEGER) AS id, title, CAST(n AS INTEGER) AS n FROM {values_sql('id, title, n', *((r[0], r[3], r[4]) for r in REPLIES))}")
def llm_json_repair(spark, sf_dir):
    given = rows(spark, "id int, reply string, n int", *(r[:3] for r in REPLIES))
    return given.withColumn("f", records.llm_fields(F.col("reply"), F.repeat(F.lit("y"), F.col("n")))).select("id", "f.title", F.length("f.text").alias("n"))


CONFIGS = [(1, '{"extract":{"max":5,"ad_markers":["x","y"]},"ignore_images":true}', 5, 2, True), (2, "{bad", 100, 0, False), (3, '{"extract":{"ad_markers":"x"}}', 100, 0, False)]


@query(f"SELECT CAST(id AS INTEGER) AS id, CAST(max AS INTEGER) AS max, CAST(markers AS INTEGER) AS markers, ignore_images FROM {values_sql('id, max, markers, ignore_images', *((r[0], *r[2:]) for r in CONFIGS))}")
def site_config(spark, sf_dir):
    """Typed settings; what can't be read, or a text in place of a list, falls back to the defaults."""
    given = rows(spark, "id int, config string", *(r[:2] for r in CONFIGS)).withColumn("c", records.site_config(F.col("config")))
    return given.select("id", F.coalesce("c.extract.max", F.lit(100)).alias("max"), F.coalesce(F.size(F.coalesce("c.extract.ad_markers", F.array().cast("array<string>"))), F.lit(0)).alias("markers"), F.coalesce("c.ignore_images", F.lit(False)).alias("ignore_images"))


CANONICAL = [("https://a.com/x", "https://a.com/y", None, "https://a.com/y"), ("https://a.com/x", "https://b.com/y", "https://a.com/z", "https://a.com/z"), ("https://a.com/x", "https://b.com/y", "https://b.com/z", "https://a.com/x"), ("https://a.com/x", None, None, "https://a.com/x")]


@query(f"SELECT url, canonical, chosen FROM {values_sql('url, canonical, og, chosen', *CANONICAL)}")
def canonical_choice(spark, sf_dir):
    given = rows(spark, "url string, canonical string, og string", *(r[:3] for r in CANONICAL))
    same = lambda a, b: urls.origin(a) == urls.origin(b)
    return given.select("url", "canonical", feeds.canonical_url(F.col("url"), F.col("canonical"), F.col("og"), same).alias("chosen"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_rows(spark, name):
    make, sql = CASES[name]
    got, want = make(spark, ""), duckdb.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.select(*(f'"{c}"' for c in columns)).fetchall()))
