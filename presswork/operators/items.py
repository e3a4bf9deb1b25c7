"""The item store: what is known, inserts that happen once, memberships, deletes, key values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions import urls


def section_items(items: DataFrame, memberships: DataFrame, keys: list[str]) -> DataFrame:
    """Items that some membership names."""
    return items.join(memberships, keys, "left_semi")


def orphans(items: DataFrame, memberships: DataFrame, keys: list[str]) -> DataFrame:
    """Items that no membership names."""
    return items.join(memberships, keys, "left_anti")


def unknown(candidates: DataFrame, items: DataFrame, url: str = "url") -> DataFrame:
    """Candidates of which neither spelling, with or without a slash at the end, is in `items` (site, hash).

    Two equality keys for each row, rather than a join with OR.
    """
    keyed = candidates.withColumn("_id", F.xxhash64("site", url))
    known = keyed.select("site", "_id", F.explode(urls.twin_hashes(F.col(url))).alias("hash")).join(items, ["site", "hash"], "left_semi").select("_id").distinct()
    return keyed.join(known, "_id", "left_anti").drop("_id")


def split_known(parsed: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, new) of parsed articles with site and hash. Known ones only get a membership."""
    keys = ["site", "hash"]
    return parsed.join(items, keys, "left_semi"), parsed.join(items, keys, "left_anti")


def first_rows(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def insert_once(new: DataFrame, existing: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows to append: those of `new` whose key isn't in `existing`, one of each key."""
    return first_rows(new.join(existing, keys, "left_anti"), keys, *order)


def insert_ignore(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return new.select(*keys).distinct().join(existing, keys, "left_anti")


def cascade(children: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Child tables without the rows of deleted parents."""
    return {name: child.join(gone, key, "left_anti") for name, child in children.items()}


def remove_section(items: DataFrame, memberships: DataFrame, site: str, section: str) -> tuple[DataFrame, DataFrame]:
    """(items, memberships) without a section: items of that section which no other section of the site has go as well."""
    gone = (F.col("site") == site) & (F.col("section") == section)
    left = memberships.where(~gone)
    lost = memberships.where(gone).select("site", "hash").join(left.select("site", "hash"), ["site", "hash"], "left_anti")
    return items.join(lost, ["site", "hash"], "left_anti"), left


def latest_values(changes: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """A key-value table from its changes: the last value of each key; a null value deletes."""
    return changes.groupBy(*keys).agg(F.max_by(value, order).alias(value)).where(F.col(value).isNotNull())


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`table` with the rows of `changes` in place of those of the same key."""
    return table.join(changes, keys, "left_anti").unionByName(changes)
