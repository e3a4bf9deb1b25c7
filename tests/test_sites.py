"""Crawls, unique names, stored pages as a source, templates as table functions, and wide pages."""

import os
import random
import time

from pyspark.sql import functions as F

from presswork.functions import html
from presswork.operators import discover, names
from presswork.plans import sites, web
from presswork.sources import pages as fetched
from presswork.sources import templates


def plain_crawl(links, found, seed, most, pages, follow, to_the_end):
    """The queue, one listing after the other."""
    queue, seen, read, merged = [seed], {seed}, [], {}
    while queue and len(merged) < most and len(read) < pages:
        url = queue.pop(0)
        place = len(read)
        read.append(url)
        for ord_, c in sorted(found.get(url, [])):
            merged.setdefault(c, (place, ord_))
        if to_the_end or place <= follow:
            for _, dst in sorted(links.get(url, [])):
                if dst not in seen:
                    seen.add(dst)
                    queue.append(dst)
    return read, merged


def test_crawl(spark):
    rng, links, found, seeds, want, merged = random.Random(3), [], [], [], [], []
    own = {}
    for site in range(12):
        n = rng.choice([1, 5, 30, 60])
        edges = {u: [(k, rng.randrange(n)) for k in range(rng.randrange(4))] for u in range(n)}
        cands = {u: [(k, rng.randrange(40)) for k in range(rng.randrange(8))] for u in range(n) if rng.random() < 0.9}
        own[site] = edges, cands
        seeds.append((site, 0))
        links += [(site, u, k, d) for u, es in edges.items() for k, d in es]
        found += [(site, u, k, c) for u, cs in cands.items() for k, c in cs]
    links.append((0, 0, 9, None))
    frames = spark.createDataFrame(links, "site int, src int, ord int, dst int"), spark.createDataFrame(found, "site int, url int, ord int, candidate int"), spark.createDataFrame(seeds, "site int, url int")
    for most, pages, follow, to_the_end in [(25, 12, 3, False), (1000, 9, 0, True)]:
        levels = []
        read, merged = discover.crawl(*frames, most, pages, follow, to_the_end, levels)
        want = {s: plain_crawl(*own[s], 0, most, pages, follow, to_the_end) for s in own}
        assert sorted((r.site, r.place, r.url) for r in read.collect()) == sorted((s, i, u) for s, (urls, _) in want.items() for i, u in enumerate(urls))
        assert sorted(map(tuple, merged.select("site", "candidate", "place", "ord").collect())) == sorted((s, c, *at) for s, (_, m) in want.items() for c, at in m.items())
        # Nothing is read that the queue wouldn't read.
        assert sum(levels) == sum(len(urls) for urls, _ in want.values())


def test_all_levels_see_the_same_candidates(spark):
    """Candidates that fall to another listing each time they are made are each met once."""
    links = spark.createDataFrame([(1, u, 0, u + 1) for u in range(3)], "site int, src long, ord int, dst long")
    anywhere = F.udf(lambda _: os.urandom(1)[0] % 4, "int").asNondeterministic()
    found = spark.range(300).select(F.lit(1).alias("site"), anywhere("id").cast("long").alias("url"), F.lit(0).alias("ord"), F.col("id").alias("candidate"))
    read, merged = discover.crawl(links, found, spark.createDataFrame([(1, 0)], "site int, url long"), most=1000, to_the_end=True)
    assert read.count() == 4 and sorted(r.candidate for r in merged.collect()) == list(range(300))


def test_tied_lines_go_by_their_place_in_the_file(spark, tmp_path):
    """Lines 10 and 11 of a supplier are of one order and number; the first listing has the part of one of them already."""
    lines = [(i, 1, 1, 100 + i) for i in range(9)] + [(9, 1, 1, 100), (9, 1, 1, 500), (10, 1, 1, 600)]
    got = []
    for k, rows in enumerate((lines, lines[::-1])):
        spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long").coalesce(1).write.parquet(str(tmp_path / f"{k}/lineitem.parquet"))
        got.append(sorted(map(tuple, sites.crawl_listings(spark, str(tmp_path / str(k))).collect())))
    assert got == [[(1, 0, 9), (1, 1, 2)], [(1, 0, 10), (1, 1, 1)]]


def test_full_sites_leave_the_frontier(spark):
    """A page with forty links: its site is full after the first level, whatever lies behind."""
    edges = spark.createDataFrame([("a", 0, i) for i in range(1, 50)] + [("a", i, 100 * i + k) for i in range(1, 50) for k in range(20)] + [("b", 0, 1), ("b", 1, 2)], "site string, src long, dst long")
    levels = []
    got = discover.frontier(edges, spark.createDataFrame([("a", 0), ("b", 0)], "site string, url long"), seen_levels=levels)
    assert got.where("site = 'a'").count() == 40 and got.where("site = 'b'").count() == 3
    assert levels == [50, 1, 0]


def plain_names(requests, taken):
    taken, out = set(taken), {}
    for id_, base in sorted(requests):
        name, n = base, 2
        while name in taken:
            name, n = f"{base}-{n}", n + 1
        taken.add(name)
        out[id_] = name
    return out


def test_unique_names(spark):
    for seed in range(3):
        rng = random.Random(seed)
        bases = ["x", "x-2", "x-2-2", "y", "x-3", "z-10", "z", "y-07", "q-1"]
        requests = [(i, rng.choice(bases)) for i in rng.sample(range(1000), 80)]
        taken = rng.sample(["x", "x-4", "x-5", "x-6", "y-2", "z-3", "x-2-3", "q", "y-9999999999"], 6)
        got = names.unique_names(spark.createDataFrame(requests, "id long, base string"), spark.createDataFrame([(t,) for t in taken], "name string"))
        assert {r.id: r.name for r in got.collect()} == plain_names(requests, taken), seed
    assert names.unique_names(spark.createDataFrame([], "id long, base string"), spark.createDataFrame([], "name string")).collect() == []


def test_stored_pages(spark, tmp_path):
    rows = [(i, f"https://h{i % 30}.example/{i}", None if i % 17 == 0 else "x" * 200 + "Just a moment" if i % 5 == 0 else f"<p>{i}</p>") for i in range(300)] + [(300, "junk", "<p>x</p>"), (301, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    fetched.keep_pages(df.repartition(4), str(tmp_path / "p"))
    fetched.keep_pages(df.where("page_id % 10 = 0").withColumn("html", F.lit("<p>late</p>")), str(tmp_path / "p"), "browser")
    got = fetched.read_stored(spark, str(tmp_path / "p"), "plain,browser")
    bad = {i for i, _, h in rows if h is None or "moment" in h}
    want = sorted((i, "browser" if i in bad and i % 10 == 0 else "plain", "ok" if i not in bad or i % 10 == 0 else "failed" if h is None else "challenge", 2 if i in bad and i % 10 == 0 else 1) for i, _, h in rows)
    assert sorted(map(tuple, got.select("page_id", "engine", "outcome", "attempts").collect())) == want
    # No host in two partitions.
    parts = got.select("host", F.spark_partition_id().alias("p")).distinct().groupBy("host").count()
    assert parts.where("count > 1").isEmpty()
    # A host's pages come from one bucket, and the filter is done by the source.
    one = got.where("host = 'h7.example'")
    assert one.rdd.getNumPartitions() == 1 and sorted(r.page_id for r in one.collect()) == list(range(7, 300, 30))
    assert sorted(r.page_id for r in got.where("page_id IN (3, 4, 500) AND outcome = 'ok'").collect()) == [3, 4]
    report = fetched.read_stored(spark, str(tmp_path / "p"), "plain,browser", report=True)
    assert {(r.engine, r.outcome): r.n for r in report.groupBy("engine", "outcome").agg(F.sum("pages").alias("n")).collect()} == {(e, o): sum(1 for w in want if w[1:3] == (e, o)) for _, e, o, _ in want}
    assert fetched.read_stored(spark, str(tmp_path / "none")).collect() == []


def test_templates_equal_the_columns(spark):
    dated = F.replace("html", F.lit('<a href="/'), F.lit('<a href="/2024/05/06/a-long-story-about-'))
    own = templates.by_host(web.pages(spark, "/root/testdata/sf0.001")).withColumn("html", dated)
    key = ["page_id", "ord", "url", "title", "date", "source", "score", "accept"]
    want = discover.score_candidates(discover.raw_candidates(own.withColumn("fields", html.page_links(F.col("html"), F.col("url")))))
    got = discover.score_candidates(templates.discover_pages(own))
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.select(*(c for c in key if c in df.columns)).collect())))
    assert rows(got) == rows(want) != []
    assert templates.register(spark) == ["discover_generic", "discover_anchors", "discover_embedded_json"]
    own.createOrReplaceTempView("own_pages")
    assert spark.sql("SELECT count(*) FROM discover_anchors(TABLE(own_pages))").first()[0] == discover.raw_candidates(own.withColumn("fields", html.page_links(F.col("html"), F.col("url")))).where("source = 'anchor'").count()
    assert spark.sql("SELECT DISTINCT source FROM discover_anchors(TABLE(own_pages))").first()[0] == "anchor"


def test_wide_and_deep_pages_take_time_by_their_size():
    took = {}
    for n in (5_000, 40_000):
        wide = "<html><body><div>" + "".join(f"<nav>n{i}</nav><p>para {i}</p><script>a()</script></b>" for i in range(n)) + "</div></body></html>"
        began = time.perf_counter()
        assert "para 4999" in html.sanitize(wide) and html.fields_of(wide, "https://a.example/x", ["ad"])["content"].count("<p>") == n
        took[n] = time.perf_counter() - began
    assert took[40_000] < 24 * took[5_000], took
    began = time.perf_counter()
    html.fields_of("<div>" * 20_000 + "x" + "</b>" * 20_000, "https://a.example/x", None)
    assert time.perf_counter() - began < 30
    assert html.sanitize("<html><body>a<html><body><p>b</p></body></html>c</body></html>") == "a<p>b</p>c"
