"""Embedded records as variants: the same as the parse of the tree gives."""

from pyspark.sql import functions as F

from presswork.functions import html
from presswork.operators import embedded

BASE = "https://a.example/news/list?x=1"
PAGES = [
    '{"items":[{"url":"/a","headline":" H ","pubDate":"2026"},{"x":{"uri":"b","title":""}},{"url":"https://other.example/z"},{"link":5,"href":"https://a.example/c"}]}',
    '[[[[{"permalink":"/deep","name":"N"}]]], 3, null, "x", {"url":"mailto:x@a.example"}]',
    '{"url":"\\/e\\/1", bad',
    "  ",
    '{"url":"//a.example/two","title":["t"],"date":7}',
    '"text"',
]


def test_records_equal_those_of_the_tree(spark):
    rows = [(i, BASE, f'<html><head><script type="application/json">{j}</script><script>{{"url":"/no"}}</script></head></html>') for i, j in enumerate(PAGES)] + [(90, BASE, None), (91, BASE, "<p>none</p>"), (92, None, rows_html())]
    got = embedded.embedded_records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    want = [(i, *r) for i, base, h in rows if h and base for r in html.embedded_records(html.parse(h), base)]
    assert sorted(map(str, (tuple(r) for r in got.select("page_id", "url", "title", "date", "source").collect()))) == sorted(map(str, want))
    assert got.agg(F.max("depth")).first()[0] == 4


def rows_html():
    return '<script type="application/json">{"url":"/x"}</script>'
