"""Feeds that are kept up to date: the best rows of every feed as a table, changed by what a batch adds or takes away.

A feed's bar is the order of its last row. A row that isn't before the bar can't be in the feed, so a batch is first held against the bars, and
only feeds with a better row are made anew, from what is kept and these rows. A feed that loses one of its rows is filled up from the items,
for nobody knows which is next; other feeds aren't read. Buckets without a changed feed aren't written.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswork.operators.feeds import feed_order
from presswork.session import stored

BUCKETS = 64


class KeptFeeds:
    """The first `limit` rows of every feed (the columns `feed`) under `root`. Items have published_at, first_seen and hash, and any more columns."""

    def __init__(self, spark: SparkSession, root: str, feed: list[str], schema: str, limit: int = 10):
        self.spark, self.root, self.feed, self.schema, self.limit = spark, root.rstrip("/"), feed, schema, limit

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of all feeds, or of the feeds in some buckets."""
        try:
            own = self.spark.read.parquet(self.root)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], self.schema)
        own = own if buckets is None else own.where(F.col("bucket").isin(buckets))
        return own.select(*self.spark.createDataFrame([], self.schema).columns)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.feed), F.lit(BUCKETS)).cast("int")

    def _best(self, rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(*self.feed).orderBy(*feed_order())
        return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= self.limit).drop("_n")

    def _buckets(self, rows: DataFrame) -> list[int]:
        return sorted(r.b for r in rows.select(self._bucket().alias("b")).distinct().collect())  # at most BUCKETS

    def _put(self, feeds: DataFrame, rows: DataFrame, buckets: list[int]) -> None:
        """Writes `rows` in place of all rows of the feeds named, leaving other feeds of their buckets as they are."""
        rest = self.read(buckets).join(feeds, self.feed, "left_anti")
        new = stored(rest.unionByName(rows)).withColumn("bucket", self._bucket())
        new.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.root)
        empty = set(buckets) - {r.bucket for r in new.select("bucket").distinct().collect()}
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for bucket in empty:
            gone = path(f"{self.root}/bucket={bucket}")
            gone.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    def add(self, batch: DataFrame) -> int:
        """Adds a batch of new items, and tells how many feeds that changed. Items that are there already change nothing."""
        columns = self.spark.createDataFrame([], self.schema).columns
        best = stored(self._best(batch.select(*columns).dropDuplicates([*self.feed, "hash"])))
        buckets = self._buckets(best)
        if not buckets:
            return 0
        kept = self.read(buckets)
        # A row sorts as this struct does, so the largest of a full feed is its bar.
        sort = F.struct(F.col("published_at").isNull().alias("a"), (-F.unix_micros(F.coalesce("published_at", "first_seen"))).alias("b"), (-F.unix_micros("first_seen")).alias("c"), F.col("hash").alias("d"))
        bars = kept.groupBy(*self.feed).agg(F.count("*").alias("_rows"), F.max(sort).alias("_bar"))
        better = best.withColumn("_own", sort).join(bars, self.feed, "left").where(F.col("_rows").isNull() | (F.col("_rows") < self.limit) | (F.col("_own") < F.col("_bar"))).select(*columns)
        fresh = stored(better.join(kept.select(*self.feed, "hash"), [*self.feed, "hash"], "left_anti"))
        changed = stored(fresh.select(*self.feed).distinct())
        touched = self._buckets(changed)
        if touched:
            self._put(changed, self._best(self.read(touched).join(changed, self.feed, "left_semi").unionByName(fresh)), touched)
        return changed.count()

    def remove(self, gone: DataFrame, items: DataFrame) -> int:
        """Takes items (the columns of the feed, and hash) away, and fills up the feeds that had them from `items`, which has them no more."""
        columns = self.spark.createDataFrame([], self.schema).columns
        buckets = self._buckets(gone)
        lost = stored(self.read(buckets).join(gone.select(*self.feed, "hash").distinct(), [*self.feed, "hash"], "left_semi").select(*self.feed).distinct())
        touched = self._buckets(lost)
        if touched:
            self._put(lost, self._best(items.select(*columns).join(lost, self.feed, "left_semi")), touched)
        return lost.count()
