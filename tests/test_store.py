"""The store: ingest happens once, in a batch or in a stream; deletes; reprofiling; reprocessing."""

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from presswork.functions import html, urls
from presswork.operators import discover, items, quality
from presswork.schemas import ITEM_SECTIONS, ITEMS, conform
from presswork.session import clear, stored
from presswork.sources import feeds as sources
from presswork.streaming.ingest import Store, bucket_of, stream

BODY = "Words of an article that is long enough to be good. " * 6


def page(i, path, extra=""):
    return (i, f"https://ex.com{path}", f"<html><head><title>T{i}</title></head><body><article><p>{BODY}{extra}</p></article></body></html>")


def site():
    return urls.host(F.col("url"))


def section():
    return F.lit("news")


def seen():
    return F.timestamp_millis(F.col("page_id") * 60000)


def outcomes(store, run):
    return {r.page_id: r.outcome for r in store.spark.read.parquet(f"{store.root}/_staged/{run}").collect()}


def test_ingest_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), keep_staged=True)
    store.add_site("ex.com", "https://ex.com/", '{"extract": {"paywall_markers": ["members only"], "ad_markers": ["buy now"]}}')
    store.add_site("idle.com", "https://idle.com/")
    store.add_section("ex.com", "news", "https://ex.com/news/")
    pages = [page(1, "/a/x"), page(2, "/a/x/"), page(3, "/a/y?utm_source=q"), (4, "https://ex.com/n", None), (5, "https://ex.com/g", "x" * 200 + "Just a moment"), page(6, "/news?page=2"), page(7, "/a/paid", "For Members Only")]
    pages += [(8, "nonsense", "<p>x</p>"), (9, "https://ex.com/a/z/", page(9, "", "</p><div><p>Buy  Now!</p></div><p>")[2].replace("<head>", '<head><link rel="canonical" href="https://ex.com/a/w">'))]
    batch = spark.createDataFrame(pages, sources.PAGES)
    store.ingest(batch, F.lit("ex.com"), section(), seen(), "r1")
    assert outcomes(store, "r1") == {1: "new", 2: "duplicate", 3: "new", 4: "failed", 5: "failed", 6: "listing", 7: "paywalled", 8: "failed", 9: "new"}
    own = {r.url: r for r in store.read("items").collect()}
    assert set(own) == {"https://ex.com/a/x", "https://ex.com/a/y", "https://ex.com/a/w"}
    assert own["https://ex.com/a/x"].raw_html == pages[0][2] and "Buy" not in own["https://ex.com/a/w"].content_html and own["https://ex.com/a/w"].metadata.canonical == "https://ex.com/a/w"
    run = store.runs("ex.com").collect()[0]
    assert (run.discovered, run.new_items, run.failed, run.paywalled, run.skipped, run.status, tuple(run.quality)) == (9, 3, 3, 1, 1, "partial", (3, 3, 0))
    assert run.error == "parse https://ex.com/n: the page is empty" and len(run.log_excerpt.split("\n")) == 3 and run.started_at <= run.finished_at
    assert [(r.status, r.error) for r in store.runs("idle.com").collect()] == [("error", "the site has no section")]
    assert [(r.url, r.retry) for r in store.to_retry().collect()] == [("https://ex.com/g", True)]
    # Known addresses, in either spelling, aren't parsed again; a page of another address whose canonical one is known gets a membership only.
    twin = [page(1, "/a/x/"), (2, "https://ex.com/q", page(2, "")[2].replace("<head>", '<head><link rel="canonical" href="/a/y/">').replace('"/a/y/"', '"https://ex.com/a/y/"'))]
    store.ingest(spark.createDataFrame(twin, sources.PAGES), F.lit("ex.com"), F.lit("other"), seen(), "r2")
    assert outcomes(store, "r2") == {1: "known", 2: "duplicate"}
    assert store.read("items").count() == 3
    members = {(r.section, r.hash) for r in store.read("item_sections").collect()}
    assert len(members) == 4 and ("other", own["https://ex.com/a/y"].hash) in members
    assert [r.new_items for r in store.runs("ex.com").collect()] == [0, 3]
    assert store.feed("ex.com", "news", 2).count() == 2 and store.index("ex.com").count() == 3
    assert [(r.site, r.n_sections, r.n_items, r.last_scrape_status) for r in store.status().collect()] == [("ex.com", 1, 3, "ok"), ("idle.com", 0, 0, "error")]


def test_a_batch_that_is_tried_again_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"), keep_staged=True)
    batch = spark.createDataFrame([page(1, "/a/x"), page(2, "/a/y"), (3, "https://ex.com/n", None)], sources.PAGES)
    append = Store.append

    def broken(name):
        def to(self, table, rows):
            if table == name:
                raise OSError("gone")
            append(self, table, rows)

        return to

    for table in ("items", "item_sections", "failures", "runs"):
        monkeypatch.setattr(Store, "append", broken(table))
        try:
            store.ingest(batch, site(), section(), seen(), "r")
            raise AssertionError("it should have failed")
        except OSError:
            monkeypatch.setattr(Store, "append", append)
    for _ in range(2):
        store.ingest(batch, site(), section(), seen(), "r")
    assert [store.read(t).count() for t in ("items", "item_sections", "failures", "runs")] == [2, 2, 1, 1]
    run = store.runs("ex.com").first()
    assert (run.discovered, run.new_items, run.failed, run.status) == (3, 2, 1, "partial")


def test_a_damaged_store_is_no_empty_store(spark, tmp_path):
    (tmp_path / "store" / "items").mkdir(parents=True)
    (tmp_path / "store" / "items" / "part-0.parquet").write_text("no parquet")
    import pytest

    with pytest.raises(Exception):  # noqa: B017
        Store(spark, str(tmp_path / "store"), keep_staged=True).read("items").count()


def test_a_feed_reads_its_own_bucket(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), keep_staged=True)
    pages = [(i, f"https://s{i}.com/a/x", page(i, "")[2]) for i in range(40)]
    store.ingest(spark.createDataFrame(pages, sources.PAGES), site(), section(), seen(), "r")
    assert {r.site for r in store.feed("s7.com", "news").collect()} == {"s7.com"} and store.read("items").count() == 40
    plan = store.feed("s7.com")._jdf.queryExecution().executedPlan().toString()
    number = spark.range(1).select(bucket_of(F.lit("s7.com"))).first()[0]
    # The site's bucket is a constant by the time files are listed.
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {number}\)", plan), plan


def test_tables_between_jobs_are_cleared(spark):
    kept = stored(spark.range(3))
    assert kept.count() == 3 and kept.inputFiles()
    clear(spark)
    import os

    assert not any(os.path.exists(f.removeprefix("file://")) for f in kept.inputFiles())


def test_values_and_removal(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), keep_staged=True)
    for value in ("1", "2"):
        store.put("s", "k", value)
    store.put("s", "other", "x")
    assert store.get("s", "k") == "2" and store.get("s", "none") is None
    store.delete("s", "k")
    assert store.get("s", "k") is None and [(r.key, r.value) for r in store.values().collect()] == [("other", "x")]
    store.add_section("ex.com", "a", "https://ex.com/la")
    store.add_section("ex.com", "b", "https://ex.com/lb")
    store.ingest(spark.createDataFrame([page(1, "/a/x"), page(2, "/a/y")], sources.PAGES), site(), F.lit("a"), seen(), "r1")
    store.ingest(spark.createDataFrame([(3, "https://ex.com/q", page(2, "")[2].replace("<head>", '<head><link rel="canonical" href="https://ex.com/a/y">'))], sources.PAGES), site(), F.lit("b"), seen(), "r2")
    store.remove("ex.com", "a")
    assert [r.url for r in store.read("items").collect()] == ["https://ex.com/a/y"] and [r.section for r in store.sections("ex.com").collect()] == ["b"]
    store.remove("ex.com")
    assert [store.read(t).where("site = 'ex.com'").count() for t in ("items", "item_sections", "sections", "runs")] == [0, 0, 0, 0]


def test_raw_pages_are_kept_where_wanted(spark, tmp_path):
    for store_raw, config, kept in ((True, None, True), (False, '{"extract": {"storeRaw": true}}', False), (True, '{"extract": {"storeRaw": false}}', False)):
        store = Store(spark, str(tmp_path / f"{store_raw}{kept}{config is None}"), keep_staged=True)
        store.add_site("ex.com", "https://ex.com", config)
        store.ingest(spark.createDataFrame([page(1, "/a/x")], sources.PAGES), site(), section(), seen(), "r", store_raw=store_raw)
        assert (store.read("items").first().raw_html is not None) == kept


def test_replies_of_a_model(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), keep_staged=True)
    reply = F.when(F.col("page_id") == 1, F.lit('{"title": "M", "text": "' + "word " * 60 + '"}'))
    store.ingest(spark.createDataFrame([page(1, "/a/x"), page(2, "/a/y")], sources.PAGES), site(), section(), seen(), "r", reply=reply, model="m1")
    assert {r.url[-1]: (r.llm.title, r.llm.model) if r.llm else None for r in store.read("items").collect()} == {"x": ("M", "m1"), "y": None}


def test_weak_runs_are_profiled_anew(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), keep_staged=True)
    store.add_site("module.com", "https://module.com", template="own.py")
    short = lambda i, host: (i, f"https://{host}/a/{i}", "<article>short</article>")
    good = (9, "https://good.com/a/9", page(9, "")[2].replace("<body>", '<body><time datetime="2024-01-02">x</time>'))
    for n in range(2):
        store.ingest(spark.createDataFrame([short(n, "weak.com"), short(n + 5, "module.com"), good], sources.PAGES), site(), section(), seen(), f"r{n}")
    assert [r.site for r in store.read("kv").collect()] == ["weak.com"]
    assert [r.site for r in store.to_reprofile(F.current_timestamp() - F.expr("INTERVAL 1 HOUR")).collect()] == ["weak.com"]


def test_reprocess_writes_back(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), keep_staged=True)
    store.ingest(spark.createDataFrame([page(1, "/a/x"), page(2, "/a/y"), page(3, "/a/z")], sources.PAGES), site(), section(), seen(), "r")
    old = store.read("items")
    store.replace("items", old.withColumn("content_hash", F.when(F.col("url").endswith("x"), "old").otherwise(F.col("content_hash"))).withColumn("raw_html", F.when(F.col("url").endswith("z"), "").otherwise(F.col("raw_html"))))
    assert store.reprocess(write=False) == {"changed": 1, "same": 1, "failed": 1}
    assert store.reprocess("ex.com") == {"changed": 1, "same": 1, "failed": 1}
    assert store.reprocess() == {"same": 2, "failed": 1} and store.read("items").count() == 3


def test_stream_is_batch(spark, tmp_path):
    rows = [page(i, f"/a/{i % 7}") for i in range(12)]
    for n in range(2):
        spark.createDataFrame(rows[n * 6 : n * 6 + 6], sources.PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streamed, whole = Store(spark, str(tmp_path / "s1"), keep_staged=True), Store(spark, str(tmp_path / "s2"), keep_staged=True)
    stream(spark, str(tmp_path / "in"), streamed, str(tmp_path / "checkpoint"), site, section, seen).awaitTermination(120)
    whole.ingest(spark.createDataFrame(rows, sources.PAGES), site(), section(), seen(), "r")
    key = lambda s: sorted((r.site, r.hash) for r in s.read("items", ITEMS).collect())
    assert key(streamed) == key(whole) and len(key(whole)) == 7


def test_remove_section(spark):
    own = spark.createDataFrame([("s", "1"), ("s", "2"), ("s", "3")], "site string, hash string")
    members = spark.createDataFrame([("s", "a", "1"), ("s", "b", "1"), ("s", "a", "2")], ITEM_SECTIONS)
    left, rest = items.remove_section(own, members, "s", "a")
    assert sorted(r.hash for r in left.collect()) == ["1", "3"]
    assert [tuple(r) for r in rest.collect()] == [("s", "b", "1")]


def test_reprocess(spark):
    raw = page(1, "/a/b")[2]
    old = spark.createDataFrame([("s", "h1", raw, "old", "Untitled"), ("s", "h2", None, "old", "kept")], "site string, hash string, raw_html string, content_hash string, title string")
    old = conform(old.withColumn("url", F.lit("https://ex.com/a/b")), ITEMS)
    out = quality.reprocess(old, html.page_fields(F.col("raw_html"), F.col("url"))).collect()
    assert [(r.hash, r.outcome) for r in out] == [("h1", "changed")]


def test_merge_ignores_what_came_before(spark):
    scored = spark.createDataFrame(
        [(1, 0, "u", "early", None, "anchor", 99, False), (1, 1, "u", None, None, "json", 10, True), (1, 2, "u", "late", "2026-01-01", "anchor", 12, False)],
        "page_id int, ord int, url string, title string, date string, source string, score int, accept boolean",
    )
    row = discover.merge_candidates(scored).first()
    assert (row.title, row.date, row.source, row.score) == ("late", "2026-01-01", "json", 12)


def test_atom_and_log(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<feed><entry><title>A</title><link href='https://a.example/x'/><published>2024-01-01T00:00:00Z</published></entry></feed>")
    assert [r.url for r in sources.atom_entries(sources.read_atom(spark, str(tmp_path / "f.xml")).withColumn("link", F.coalesce("link", F.lit("https://a.example/x")))).collect()] == ["https://a.example/x"]
    (tmp_path / "log.jsonl").write_text('{"ts":"2024-01-01T00:00:00Z","site":"a","msg":"x"}\nbroken\n{"ts":"2024-01-02T00:00:00Z","site":"b","msg":"y"}\n')
    assert [r.msg for r in sources.read_log(spark, str(tmp_path / "log.jsonl")).collect()] == ["y", "x"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "site string, hash string")
    assert items.insert_once(none, none, ["site", "hash"], "hash").count() == 0
    assert items.orphans(none, none, ["site", "hash"]).count() == 0
