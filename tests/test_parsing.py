"""Pages are parsed once, in time that grows with their length, and their content is chosen and cleaned as told."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from presswork.functions import html
from presswork.operators import discover
from presswork.plans import derived, registry, web
from presswork.sources import feeds as sources

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("make", [web.site_feed_topk, web.page_anchors, web.page_fields, web.clean_article, derived.embedded_json, derived.ingest_outcomes], ids=lambda f: f.__name__)
def test_one_parse(spark, make):
    plan = make(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [_page_") + plan.count("_page_fields(") + plan.count("_page_links(") >= 1
    assert sum(line.strip(" :+-").startswith("ArrowEvalPython") for line in plan.split("\n")) == 1


def content(page, markers=None):
    return html.fields_of(page, "https://e.com/d/", markers)["content"]


def test_content_by_density():
    text = "Some words of the body that make it the longest block. " * 5
    links = "".join(f"<a href='/{i}'>a long link text to somewhere {i}</a>" for i in range(40))
    page = f"<body><div id='menu'>{links}</div><div id='body'><p>{text}</p><p>{text}</p></div><div>short</div></body>"
    assert content(page).count("Some words") == 10 and "link text" not in content(page)
    assert content("<body><div> </div></body>") is None and content("") is None and content("<body></body>") is None


def test_boilerplate_goes():
    keep = "<p>" + "Body text. " * 30 + "</p>"
    gone = ["<footer>f</footer>", "<nav>n</nav>", "<div role='navigation'>r</div>", "<div class='a footer'>c</div>", "<div id='footer'>i</div>", "<div data-function-block='Breadcrumb-1'>b</div>"]
    assert content(f"<article>{keep}{''.join(gone)}</article>") == keep
    assert html.strip_boilerplate(f"{keep}{''.join(gone)}") == keep
    assert html.strip_boilerplate("<!-- Logo for print --><img src='x'>y</p>" + keep) == keep
    assert content(f"<article><p><span>An article from</span> <b>us</b></p>{keep}</article>") == keep


def test_ads_go_and_addresses_are_whole():
    keep = "<p>" + "Body text. " * 80 + "find out more</p>"
    page = f"<article><div><p>Find  OUT more</p></div><img src='a.png'><a href='../x'>x</a>{keep}</article>"
    assert content(page, ["find out more"]) == f'<img src="https://e.com/d/a.png"><a href="https://e.com/x">x</a>{keep}'


@pytest.mark.parametrize("markers", [None, ["nothing"]])
def test_nested_blocks_take_linear_time(markers):
    times = []
    for n in (1000, 8000):
        page = "<body>" + "<div>text " * n + "</div>" * n + "</body>"
        begin = time.time()
        html.fields_of(page, "https://e.com/", markers)
        times.append(time.time() - begin)
    assert times[1] < 24 * times[0] + 1


def test_modes_of_candidates(spark):
    raw = spark.createDataFrame(
        [(1, "https://e.com/", 0, "https://e.com/2024/01/02/a", "x", None, "anchor"), (1, "https://e.com/", 1, "https://e.com/2024/01/02/b", "y", None, "json"), (1, "https://e.com/", 2, "https://e.com/2024/01/02/c", "z", "2024-01-01", "json")],
        "page_id int, index_url string, ord int, url string, title string, date string, source string",
    )
    got = {mode: sorted(r.url[-1] for r in discover.score_candidates(raw, mode).collect()) for mode in ("auto", "embedded-json", "anchors")}
    assert got == {"auto": ["a", "b", "c"], "embedded-json": ["b", "c"], "anchors": ["a", "c"]}


def test_links_without_the_rest(spark):
    page = "<body><a href='/x'>X</a><script type='application/json'>{\"url\": \"/y\"}</script></body>"
    df = spark.createDataFrame([(1, "https://e.com/", page), (2, "https://e.com/", None)], sources.PAGES)
    both = df.select(html.page_links(F.col("html"), F.col("url")).alias("l"), html.page_fields(F.col("html"), F.col("url")).alias("f")).collect()
    assert [(r.l.anchors, r.l.records) for r in both] == [(r.f.anchors, r.f.records) for r in both] and both[0].l.anchors[0].url == "https://e.com/x"


CUT = "words of a body &amp; more&ampThe &lt;b&gt; " * 8


@pytest.mark.parametrize("name", ["clean_article", "sanitized_pages"])
def test_ampersands_that_begin_no_whole_reference(spark, tmp_path, name):
    """Texts that were cut within a reference, as SQL has them."""
    duckdb = pytest.importorskip("duckdb")
    cuts = ["&", "&a", "&am", "&amp", "&amp;", "&amp;&ampx", "&lt", "&#38", "&copy"]
    page = "<html><head><title>Ly {0}</title></head><body><article><p>{1}{0}</p><p>End {0}Th</p></article></body></html>"
    rows = [(i, "https://e.com/a", page.format(c, CUT)) for i, c in enumerate(cuts)]
    spark.createDataFrame(rows, sources.PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(registry.SQL[name]).fetchall()
    assert sorted(map(tuple, getattr(web if name == "clean_article" else derived, name)(spark, str(tmp_path)).collect())) == sorted(want)


def test_loose_ampersands_elsewhere():
    page = "<p title='a&copy=1&amp;b'>x&ampT &notit; &amp;lt;</p><script>a && b</script><!-- & -->﷐&"
    root = html.parse(page)
    assert root.find("p").attrs["title"] == "a&copy=1&b" and root.find("script").text() == "a && b"
    assert root.find("p").text() == "x&ampT &notit; &lt;"
    assert root.html() == '<p title="a&amp;copy=1&amp;b">x&ampT &notit; &amp;lt;</p><script>a && b</script><!-- & -->﷐&'


def batch_of(n, size):
    pages = pd.Series([f"<html><head><title>T{i}</title></head><body><article><a href='/{i}'>{i}</a>{'word ' * (size // 5)}</article></body></html>" for i in range(n)] + [None])
    return pages, pd.Series(["https://e.com/"] * (n + 1)), pd.Series([None] * (n + 1))


def test_fields_of_a_batch_come_in_parts():
    pages, urls, markers = batch_of(40, html.PART // 8)
    frames = list(html._page_fields(iter([(pages, urls, markers)] * 2)))
    assert len(frames) >= 10 and max(map(len, frames)) <= 9
    assert [t for f in frames for t in f["title"]] == [*(f"T{i}" for i in range(40)), None] * 2


def test_parts_of_a_batch():
    sizes = [html.PART // 2 + 1, 1, html.PART // 2, 3 * html.PART, 0, 5]
    cut = list(html.parts(pd.Series(["x" * n if n else None for n in sizes])))
    assert [(s.start, s.stop) for s in cut] == [(0, 3), (3, 4), (4, 6)]
    assert list(html.parts(pd.Series([], dtype=object))) == []


def test_links_and_sanitized_pages_come_in_parts():
    pages, urls, _ = batch_of(20, html.PART // 4)
    links = list(html._page_links(iter([(pages, urls)])))
    clean = list(html._sanitize(iter([pages])))
    assert len(links) == len(clean) == 6
    assert [a["url"] for f in links for anchors in f["anchors"] for a in anchors] == [f"https://e.com/{i}" for i in range(20)]
    assert [x for s in clean for x in s] == [*map(html.sanitize, pages[:20]), None]
