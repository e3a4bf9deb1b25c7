from datetime import datetime

import pytest
from pyspark.sql import functions as F

from presswork.functions import dates, html, records, text, urls
from presswork.sources import settings


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Ex.com//a//b?utm_source=x&q=1#f", "https://ex.com/a/b?q=1"),
        ("http://ex.com/a?page=2&ref=x", "http://ex.com/a?page=2"),
        ("//ex.com/a", "https://ex.com/a"),
        ("http://ex.com:80", "http://ex.com/"),
        ("not a url", None),
        (None, None),
    ],
)
def test_normalize_url(spark, url, want):
    u = F.col("u").cast("string")
    assert one(spark, urls.normalize_url(u), u=url) == want
    if want:
        assert one(spark, urls.normalize_url(u), u=want) == want


def test_url_parts(spark):
    u = F.col("u")
    twins = urls.twin_hashes(u)
    assert one(spark, twins, u="https://x.com/slug") == one(spark, twins, u="https://x.com/slug/")
    assert [one(spark, urls.page_number(u), u=x) for x in ("https://x.com/?page=3", "https://x.com/page/4/", "https://x.com/x")] == [3, 4, None]
    assert [one(spark, urls.site_id(u), u=x) for x in ("https://investor.visa.com", "https://thepaypers.com/a")] == ["visa", "thepaypers"]
    assert [one(spark, urls.section_id(u), u=x) for x in ("https://x.com/a/Some Topic!", "https://x.com/")] == ["some-20topic", "index"]
    assert one(spark, urls.path_score(u), u="https://x.com/2026/08/12/slug") == 53
    assert one(spark, urls.is_usable(u), u="https://x.com/tag/x") is False


def test_text(spark):
    t = F.col("t")
    assert one(spark, text.cdata(t), t="a]]>b") == "a]]]]><![CDATA[>b"
    assert one(spark, text.text_to_html(t), t="a\nb\n\n<c>") == "<p>a b</p>\n<p>&lt;c&gt;</p>"
    assert one(spark, text.strip_markdown(t), t="**b** *i* `c`") == "b i c"
    assert one(spark, text.collapse(t), t=" a   b\n") == "a b"
    assert one(spark, text.feed_title(F.col("a"), F.col("b")), a="X News", b="news") == "X News"


def test_cron():
    at = datetime(2024, 1, 1, 0, 10)
    assert dates.next_run("*/15 * * * *", at) == datetime(2024, 1, 1, 0, 15)
    assert dates.next_run("0 0 13 * 5", at) == datetime(2024, 1, 5)
    assert dates.next_run("0 0 31 2 *", at) == datetime(2024, 1, 1, 1, 10)
    assert dates.is_cron("0 0 * * 7") and not dates.is_cron("0 0 * *") and not dates.is_cron("61 * * * *")
    assert dates.retry_after_ms("7") == 7000 and dates.retry_after_ms("900") == 60000 and dates.retry_after_ms(None) == 25000


def test_html():
    root = html.parse("<html><body><nav><a href='/x'>n</a></nav><div><p>one<p>two &amp; three<script>no()</script></div></body></html>")
    assert html.page_text(root) == "onetwo & three"
    assert "on" not in html.sanitize('<p onclick="x()">a</p>').replace("<p>", "")
    unsafe = html.sanitize('<script>x</script><a href=" javascript:y">b</a><img src="/r.png"><img src="https://e/i.png">')
    assert unsafe == '<a>b</a><img><img src="https://e/i.png">'
    assert html.strip_ads("<div><p>Find  OUT more</p><p>body</p></div>", ["find out"]) == "" or "Find" not in html.strip_ads("<section><p>Find  OUT more</p></section><p>body</p>", ["find out"])
    form = html.parse("<body><form>" + "words " * 50 + "</form></body>")
    assert len(html.page_text(form)) > 100
    assert html.absolutize('<img srcset="/a.png 1x, /b.png 2x"><a href="#t">x</a>', "https://e.com/d/") == '<img src="https://e.com/a.png"><a href="#t">x</a>'
    assert html.parse("<p>" * 3000).find("p") is not None


def test_records(spark):
    assert records.first_object('x {"a": "b\nc"} y') == '{"a": "b\\nc"}'
    assert records.first_object("x {bad") is None
    assert one(spark, records.profile_json(mode=(F.lit("anchors"), "auto"), max=(F.lit(100), 100), follow=(F.lit(5), 3), followUntil404=(F.lit(True), False))) == '{"mode":"anchors","follow":5,"followUntil404":true}'
    assert one(spark, records.drop_key(F.col("t"), "engine"), t='{"engine":"x","a":"1"}') == '{"a":"1"}'


def test_settings():
    config = settings.load('{"http": {"timeout_sec": 5}, "key": "${K}"}', {"K": "v"})
    assert config["http"]["timeout_sec"] == 5 and config["key"] == "v" and config["defaults"]["max"] == 100
    assert settings.get(settings.put(config, "a.b.c", 1), "a.b.c") == 1
    assert [settings.coerce(x) for x in ("true", "3", "1.5", "x")] == [True, 3, 1.5, "x"]
