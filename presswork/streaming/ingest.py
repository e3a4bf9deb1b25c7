"""The content store and its incremental ingest: each micro-batch of pages adds items that the store doesn't have, once and for all.

The store itself is the memory of what is known, so there is no watermark and nothing expires. What becomes of a batch's
pages is decided once and written; a batch that is tried again goes on from there, and every table takes a row once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from presswork.functions import dates, html, text, urls
from presswork.operators import batches, discover, feeds, items, profile, quality
from presswork.schemas import DECIDED, TABLES, conform
from presswork.session import stored
from presswork.sources.feeds import PAGES

REPROFILED = "reprofiled_at"
#: Tables that grow with what is stored are partitioned by a bucket of the site, so that a batch or a feed reads its sites' part.
BY_SITE = {"items", "item_sections", "runs", "failures", "kv"}
BUCKETS = 64
#: Columns of a site that can be set later.
SETTABLE = ("url", "title", "description", "schedule", "config_json", "module_path", "private")


def bucket_of(site: Column) -> Column:
    return F.pmod(F.xxhash64(site), F.lit(BUCKETS)).cast("int")


def parsed_articles(pages: DataFrame, site: Column, first_seen: Column, paywall: list[str] | None = None, ad_markers: list[str] | None = None) -> DataFrame:
    """Pages as rows of `items`, with body_good, date_good and paywalled. Pages without content or address go."""
    markers = F.array(*map(F.lit, ad_markers or [])).cast("array<string>")
    wanted = pages.where(urls.normalize_url(F.col("url")).isNotNull())
    parsed = wanted.withColumn("f", html.page_fields(F.col("html"), F.col("url"), markers)).where("f.content IS NOT NULL")
    same = lambda a, b: urls.origin(a) == urls.origin(b)
    url = urls.normalize_url(feeds.canonical_url(F.col("url"), F.col("f.metadata.canonical"), F.col("f.metadata.ogUrl"), same))
    published = dates.parse_date(F.col("f.metadata.publishedAt"))
    return parsed.select(
        site.alias("site"),
        F.sha1(url).alias("hash"),
        url.alias("url"),
        F.coalesce(feeds.first_filled(F.col("f.metadata.title"), F.col("f.title")), F.lit("Untitled")).alias("title"),
        published.alias("published_at"),
        first_seen.alias("first_seen"),
        F.sha1("f.content").alias("content_hash"),
        F.col("f.content").alias("content_html"),
        F.col("f.content_text").alias("text"),
        text.body_good(F.col("f.content_text")).alias("body_good"),
        published.isNotNull().alias("date_good"),
        text.has_marker(F.col("f.content_text"), F.array(*map(F.lit, paywall or [])).cast("array<string>")).alias("paywalled"),
    )


class Store:
    """Tables of the content store as Parquet folders under `root`. `keep_staged`: what became of each batch's pages stays in `_staged/<run>`."""

    def __init__(self, spark: SparkSession, root: str, keep_staged: bool = False):
        self.spark, self.root, self.keep_staged = spark, root.rstrip("/"), keep_staged

    def read(self, name: str, schema: str | None = None, buckets: Column | list[int] | None = None) -> DataFrame:
        """A table; one that was never written, or has no files any more, is empty. Any other trouble is an error. `buckets`: which of them are wanted."""
        schema = schema or TABLES[name]
        try:
            own = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], schema)
        if buckets is not None and "bucket" in own.columns:
            own = own.where(F.col("bucket").isin(buckets) if isinstance(buckets, list) else F.col("bucket") == buckets)
        return conform(own, schema)

    def _write(self, name: str, rows: DataFrame, mode: str) -> None:
        if name in BY_SITE:
            # Files of about the advisory size: a large bucket, or a large site, is split among tasks, and small ones are put together.
            dealt = rows.withColumn("bucket", bucket_of(F.col("site"))).hint("rebalance", F.col("bucket"))
            dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/{name}")
        else:
            rows.write.mode(mode).parquet(f"{self.root}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        self._write(name, conform(rows, TABLES[name]), "append")

    def replace(self, name: str, rows: DataFrame, buckets: list[int] | None = None) -> None:
        """The table's new rows, which may come from its old ones; of `buckets` only, all files of other ones staying as they are.

        Nobody else may write to these buckets meanwhile.
        """
        new = stored(conform(rows, TABLES[name]))
        self._write(name, new, "overwrite")
        if name in BY_SITE:
            # An overwrite leaves alone what it has no row for. At most BUCKETS numbers.
            left = {r.b for r in new.select(bucket_of(F.col("site")).alias("b")).distinct().collect()}
            for bucket in set(range(BUCKETS) if buckets is None else buckets) - left:
                self._delete(f"{name}/bucket={bucket}")

    def _delete(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def bucket(self, site: str) -> int:
        return self.spark.range(1).select(bucket_of(F.lit(site))).first()[0]

    def compact(self, name: str, files: int = 8) -> list[int]:
        """Puts the files of each bucket that has more than `files` of them together. Which buckets these were."""
        own = self.read(name)
        if name not in BY_SITE or own.isEmpty():
            return []
        named = self.spark.read.parquet(f"{self.root}/{name}").select("bucket", F.col("_metadata.file_path").alias("file")).distinct()
        many = sorted(r.bucket for r in named.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > files).collect())
        if many:
            self.replace(name, self.read(name, buckets=many), many)
        return many

    # Sites, sections and key values

    def add_site(self, site: str, url: str, config_json: str | None = None, template: str = "generic") -> None:
        row = self.spark.createDataFrame([(site, url, config_json, template)], "site string, url string, config_json string, module_path string")
        self.append("sites", items.insert_once(row.withColumn("created_at", F.current_timestamp()), self.read("sites"), ["site"], "url"))

    def add_section(self, site: str, section: str, index_url: str) -> None:
        row = self.spark.createDataFrame([(site, section, index_url)], "site string, section string, index_url string")
        self.append("sections", items.insert_once(row.withColumn("created_at", F.current_timestamp()), self.read("sections"), ["site", "section"], "index_url"))

    def update_site(self, site: str, **values: object) -> bool:
        """Sets columns of a site: url, title, description, schedule, config_json, module_path, private. Whether there is such a site."""
        if wrong := set(values) - set(SETTABLE):
            raise ValueError(f"can't be set: {sorted(wrong)}")
        own = self.read("sites")
        if own.where(F.col("site") == site).isEmpty():
            return False
        kinds = dict(own.dtypes)
        change = self.spark.createDataFrame([(site, *values.values())], f"site string, {', '.join(f'{c} {kinds[c]}' for c in values)}")
        self._update_sites(change)
        return True

    def set_config(self, site: str, **values: object) -> bool:
        """Sets top-level settings of a site's JSON, such as scrape_delay or ignore_images; None takes one away."""
        row = self.read("sites").where(F.col("site") == site).select("config_json").first()
        if row is None:
            return False
        try:
            own = json.loads(row.config_json or "{}")
        except ValueError:
            own = {}
        new = {k: v for k, v in (own | values).items() if v is not None}
        return self.update_site(site, config_json=json.dumps(new))

    def _update_sites(self, changes: DataFrame) -> None:
        """Sets what `changes` (site, and columns of sites) says."""
        own, columns = self.read("sites"), [c for c in changes.columns if c != "site"]
        new = changes.select("site", F.lit(True).alias("_set"), *(F.col(c).alias(f"_{c}") for c in columns))
        joined = own.join(new, "site", "left")
        self.replace("sites", joined.select(*(F.when(F.col("_set"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in own.columns)))

    def sites(self) -> DataFrame:
        """All sites by id, with what their last run says."""
        return feeds.site_listing(self.read("sites"), self.read("runs")).orderBy("site")

    def total(self) -> DataFrame:
        """One row: items, and sites that have any."""
        return feeds.grand_total(self.read("items", "site string"))

    def section_counts(self, site: str) -> DataFrame:
        own = self.read("item_sections", buckets=bucket_of(F.lit(site))).where(F.col("site") == site)
        return feeds.section_counts(own, ["section"])

    def sections(self, site: str) -> DataFrame:
        return self.read("sections").where(F.col("site") == site).orderBy("created_at", "section")

    def status(self) -> DataFrame:
        """Per site: sections, items and the last run."""
        counts = feeds.site_status(self.read("sites").select("site"), self.read("sections"), self.read("items", "site string"))
        return counts.join(self.sites().select("site", "last_scrape_at", "last_scrape_status", "last_error"), "site", "left").orderBy("site")

    def values(self) -> DataFrame:
        """(site, key, value) of all keys that are set."""
        return items.latest_values(self.read("kv"), ["site", "key"], "value", "at")

    def get(self, site: str, key: str) -> str | None:
        own = self.read("kv", buckets=bucket_of(F.lit(site))).where((F.col("site") == site) & (F.col("key") == key))
        row = items.latest_values(own, ["site", "key"], "value", "at").first()
        return row and row.value

    def put(self, site: str, key: str, value: str | None) -> None:
        self.append("kv", self.spark.createDataFrame([(site, key, value)], "site string, key string, value string").withColumn("at", F.current_timestamp()))

    def delete(self, site: str, key: str) -> None:
        self.put(site, key, None)

    def remove(self, site: str, section: str | None = None) -> None:
        """Without a site, or a section and the items that no other section of the site has. Only the site's bucket is written."""
        bucket = [self.bucket(site)]
        if section is None:
            gone = self.spark.createDataFrame([(site,)], "site string")
            for name in ("items", "item_sections", "sections", "runs", "failures", "kv", "sites"):
                self.replace(name, items.cascade({name: self.read(name, buckets=bucket)}, gone, "site")[name], bucket)
            return
        left, members = items.remove_section(self.read("items", buckets=bucket), self.read("item_sections", buckets=bucket), site, section)
        left, members = stored(left), stored(members)
        self.replace("items", left, bucket)
        self.replace("item_sections", members, bucket)
        self.replace("sections", self.read("sections").where((F.col("site") != site) | (F.col("section") != section)))

    # Ingest

    def ingest(self, pages: DataFrame, site: Column, section: Column, first_seen: Column, run: str, **options) -> None:
        """One batch: known pages and listings go before they are parsed, the rest is parsed once; items, memberships, failures and the run row are added."""
        staged, done = f"{self.root}/_staged/{run}", f"{run}/done"
        if not self.read("decided").where(F.col("run") == done).isEmpty():
            return
        # At most BUCKETS numbers.
        buckets = [r.b for r in pages.select(bucket_of(site).alias("b")).distinct().collect() if r.b is not None]
        if self.read("decided").where(F.col("run") == run).isEmpty():
            seen = pages.withColumn("site", site).withColumn("section", section).withColumn("first_seen", first_seen)
            known = batches.known_keys(self.read("items", "site string, url string, hash string", buckets))
            judged = batches.judge(seen, known, self.read("sections"), self.read("sites"), **options)
            judged.withColumn("started_at", F.current_timestamp()).write.mode("overwrite").parquet(staged)
            self.append("decided", self.spark.createDataFrame([(run,)], DECIDED))
        batch = self.spark.read.parquet(staged)
        # Each table takes what it doesn't have yet; the run row comes last, and says that all of it is there.
        self.append("items", items.insert_once(batches.new_items(batch), self.read("items", "site string, hash string", buckets), ["site", "hash"], "first_seen", "url"))
        self.append("item_sections", items.insert_ignore(batches.memberships(batch), self.read("item_sections", buckets=buckets), ["site", "section", "hash"]))
        own = self.read("failures", buckets=buckets).where(F.col("run") == run).select("site", "page_id")
        self.append("failures", batches.failures(batch).join(own, ["site", "page_id"], "left_anti").withColumn("run", F.lit(run)))
        idle = self.read("sites").join(self.read("sections"), "site", "left_anti")
        rows = stored(batches.run_rows(batch, idle))
        self._stamp_reprofiles(rows)
        start = batch.agg(F.min("started_at").alias("started_at"))
        there = self.read("runs").where(F.col("id") == run).select("site")
        int_ = lambda c: F.col(c).cast("int")
        finished = rows.join(there, "site", "left_anti").select("*", F.lit(run).alias("id"), F.current_timestamp().alias("finished_at"), F.lit(start.first().started_at).cast("timestamp").alias("started_at"), F.struct(int_("new_items").alias("parsed"), int_("body_ok").alias("bodyGood"), int_("date_ok").alias("dateGood")).alias("quality"))
        self.append("runs", finished)
        self.append("decided", self.spark.createDataFrame([(done,)], DECIDED))
        if not self.keep_staged:
            self._delete(f"_staged/{run}")

    def _stamp_reprofiles(self, rows: DataFrame) -> None:
        stamps = self.values().where(F.col("key") == REPROFILED).select("site", F.col("value").cast("timestamp").alias(REPROFILED))
        sites = self.read("sites").select("site", F.col("module_path").alias("template"))
        due = quality.reprofile_due(rows, sites, stamps, F.current_timestamp())
        self.append("kv", due.select("site", F.lit(REPROFILED).alias("key"), F.current_timestamp().cast("string").alias("value"), F.current_timestamp().alias("at")))

    def to_reprofile(self, since: Column) -> DataFrame:
        """Sites whose extraction a run found weak since then."""
        return self.values().where((F.col("key") == REPROFILED) & (F.col("value").cast("timestamp") >= since)).select("site", F.col("value").cast("timestamp").alias(REPROFILED))

    def reprofile(self, index_pages: DataFrame, since: Column, defaults: dict[str, str] | None = None) -> DataFrame:
        """Profiles the sites that a run found weak since then, by the page of their first section, and writes their settings.

        index_pages: page_id, url, html. A site without such a page stays as it is. The result: site, mode, candidates, changed, config_json.
        """
        due = self.to_reprofile(since).select("site")
        index = self.read("sections").join(due, "site", "left_semi").groupBy("site").agg(F.min_by("index_url", F.struct("created_at", "section")).alias("index_url"))
        address = lambda url: urls.twin_hashes(urls.normalize_url(F.col(url)))[0]
        own = index.withColumn("at", address("index_url")).drop("index_url")
        met = index_pages.withColumn("at", address("url")).join(own, "at").groupBy("site").agg(F.min_by(F.struct("page_id", "url", "html"), "page_id").alias("p"))
        raw = met.select("site", "p.*").select("site", F.xxhash64("site").alias("page_id"), "url", html.page_links(F.col("html"), F.col("url")).alias("fields"))
        found = profile.profiles(discover.raw_candidates(raw))
        named = met.select("site", F.xxhash64("site").alias("page_id")).join(found, "page_id", "left").drop("page_id")
        done = stored(profile.reprofiled(self.read("sites").select("site", "config_json"), named, defaults))
        changed = done.where("changed").select("site", "config_json")
        if not changed.isEmpty():
            self._update_sites(changed)
        return done

    def to_retry(self) -> DataFrame:
        """Challenge pages, for another engine, as long as no item has their address."""
        known = batches.known_keys(self.read("items", "site string, url string, hash string")).select("site", "key")
        waiting = self.read("failures").where("retry").dropDuplicates(["site", "url"]).withColumn("key", urls.twin_hashes(F.col("url"))[0])
        return waiting.join(known, ["site", "key"], "left_anti").drop("key")

    def reprocess(self, site: str | None = None, write: bool = True) -> dict[str, int]:
        """Reads the stored pages of all items, or of a site's, anew, and writes the buckets in which something has changed. How many changed, stayed the same, and failed."""
        scope = self.read("items") if site is None else self.read("items", buckets=[self.bucket(site)]).where(F.col("site") == site)
        done = stored(quality.reprocess(scope, html.page_fields(F.col("raw_html"), F.col("url"))))
        changed = done.where("outcome = 'changed'").drop("outcome")
        touched = [r.b for r in changed.select(bucket_of(F.col("site")).alias("b")).distinct().collect()]  # at most BUCKETS
        if write and touched:
            own = self.read("items", buckets=touched)
            rest = [c for c in own.columns if c not in changed.columns or c in ("site", "hash")]
            self.replace("items", items.upsert(own, own.select(*rest).join(changed, ["site", "hash"]), ["site", "hash"]), touched)
        return {r.outcome: r.n for r in quality.outcome_counts(done).collect()}

    # Reading

    def feed(self, site: str, section: str | None = None, limit: int = 10) -> DataFrame:
        bucket = bucket_of(F.lit(site))
        own = self.read("items", buckets=bucket).where(F.col("site") == site)
        if section:
            own = items.section_items(own, self.read("item_sections", buckets=bucket).where((F.col("site") == site) & (F.col("section") == section)), ["site", "hash"])
        return feeds.top_items(own, limit)

    def served(self, site: str, section: str | None = None, limit: int = 10, **defaults) -> DataFrame:
        """A feed's items as they are served: by the site's settings, a model's fields over the page's, and without images."""
        own = feeds.with_settings(self.feed(site, section, limit), self.read("sites").where(F.col("site") == site), **defaults)
        return feeds.feed_fields(own, F.col("prefer_model"), F.col("no_images"))

    def index(self, site: str) -> DataFrame:
        """A site's newest items for its index page."""
        return self.feed(site, limit=feeds.INDEX_ITEMS)

    def runs(self, site: str, last: int = 20) -> DataFrame:
        return self.read("runs", buckets=bucket_of(F.lit(site))).where(F.col("site") == site).orderBy(F.desc("finished_at"), F.desc("id")).limit(last)

    def recent_runs(self, last: int = 20) -> DataFrame:
        """The last runs of every site."""
        return quality.recent_runs(self.read("runs"), last)


def stream(spark: SparkSession, source: str, store: Store, checkpoint: str, site: Callable[[], Column], section: Callable[[], Column], first_seen: Callable[[], Column], files_per_batch: int = 1, **options) -> StreamingQuery:
    """Ingests a folder of page files, batch by batch, until none is left."""
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    name = checkpoint.rstrip("/").rsplit("/", 1)[-1]

    def batch(df: DataFrame, number: int) -> None:
        store.ingest(df, site(), section(), first_seen(), f"{name}-{number}", **options)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
