"""Runs: counters, rates, status, error excerpts, and when a site should be profiled anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEAK = 0.6
COOLDOWN_HOURS = 6
EXCERPT_ERRORS, EXCERPT_CHARS = 5, 2000


def run_quality(inserted: DataFrame, keys: list[str]) -> DataFrame:
    """Counters over newly inserted rows (body_good, date_good): parsed, bodies and dates that are good, rates, and whether the run is weak."""
    counts = inserted.groupBy(*keys).agg(F.count("*").alias("parsed"), F.count_if("body_good").alias("body_ok"), F.count_if("date_good").alias("date_ok"))
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    rate = lambda c: F.when(F.col("parsed") > 0, F.col(c) / F.col("parsed"))
    rated = counts.withColumn("body_rate", rate("body_ok")).withColumn("date_rate", rate("date_ok"))
    return rated.withColumn("weak", F.coalesce((F.col("body_rate") < WEAK) | (F.col("date_rate") < WEAK), F.lit(False)))


def run_status(fatal: Column, sections: Column, failures: Column) -> Column:
    """`error` without sections or on a fatal error, `partial` after any failure, else `ok`. If all articles failed it is still partial."""
    return F.when(fatal | (sections == 0), "error").when(failures > 0, "partial").otherwise("ok")


def error_excerpt(errors: DataFrame, keys: list[str], order: str, message: str) -> DataFrame:
    """The first error, and the first five by line, of each run."""
    # min_by keeps one row; the five come from an aggregation over rows ranked per run, not from all of a run's errors.
    ranked = errors.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= EXCERPT_ERRORS)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", message))), lambda x: x[message])
    return ranked.groupBy(*keys).agg(F.min_by(message, "_n").alias("error"), F.left(F.array_join(listed, "\n"), F.lit(EXCERPT_CHARS)).alias("log_excerpt"))


def quality_text(body: Column, date: Column, parsed: Column) -> Column:
    return F.format_string("body %d/%d, date %d/%d", body, parsed, date, parsed)


def reprofile_due(runs: DataFrame, sites: DataFrame, stamps: DataFrame, now: Column) -> DataFrame:
    """Sites to profile anew: generic ones of a weak run, if that hasn't been done in the last six hours.

    runs: site, parsed, body_ok, date_ok. sites: site, template (null is generic). stamps: site, reprofiled_at.
    """
    weak = with_rates(runs.select("site", F.col("new_items").alias("parsed"), "body_ok", "date_ok")).where("weak").select("site")
    generic = sites.where(F.coalesce("template", F.lit("generic")) != "generic").select("site")
    due = weak.join(generic, "site", "left_anti").join(stamps, "site", "left")
    return due.where(F.col("reprofiled_at").isNull() | (F.col("reprofiled_at") + F.expr(f"INTERVAL {COOLDOWN_HOURS} HOURS") < now)).select("site").distinct()


def reprocess(items: DataFrame, fields: Column, refetch: bool = False) -> DataFrame:
    """What the stored pages of items give now: content, date and title, and whether that is `changed` or the `same`.

    Where a page gives no content any more, the outcome is `failed` and the item stays as it is. `fields`: parsed from raw_html.
    """
    from presswork.functions.dates import parse_date

    scope = items if refetch else items.where("raw_html IS NOT NULL")
    parsed = scope.withColumn("f", fields)
    failed = F.col("f.content").isNull()
    new_hash, new_date = F.sha1("f.content"), parse_date(F.col("f.metadata.publishedAt"))
    content = ~failed & ~F.col("content_hash").eqNullSafe(new_hash)
    date = ~failed & new_date.isNotNull() & ~F.col("published_at").eqNullSafe(new_date)
    title = ~failed & F.coalesce("title", F.lit("")).isin("", "Untitled") & F.col("f.metadata.title").isNotNull()
    return parsed.select(
        "site",
        "hash",
        F.when(content, F.col("f.content")).otherwise(F.col("content_html")).alias("content_html"),
        F.when(content, new_hash).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(date, new_date).otherwise(F.col("published_at")).alias("published_at"),
        F.when(title, F.col("f.metadata.title")).otherwise(F.col("title")).alias("title"),
        F.when(failed, "failed").when(content | date | title, "changed").otherwise("same").alias("outcome"),
    )


def outcome_counts(outcomes: DataFrame, **also: Column) -> DataFrame:
    """How many rows have each outcome, and of `also` in how many of them the condition holds."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"), *(F.count_if(condition).alias(name) for name, condition in also.items()))


def run_counts(runs: DataFrame) -> DataFrame:
    """(site, finished, unfinished): runs of each site that have ended, and that haven't."""
    return runs.groupBy("site").agg(F.count("finished_at").alias("finished"), F.count_if(F.col("finished_at").isNull()).alias("unfinished"))


def recent_runs(runs: DataFrame, last: int = 20, *order: Column) -> DataFrame:
    """The last runs of every site with their `rank`, by when they ended unless another order is given."""
    latest = Window.partitionBy("site").orderBy(*(order or (F.desc("finished_at"), F.desc("id"))))
    return runs.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= last)
