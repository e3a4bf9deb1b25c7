"""Unique identifiers for many requests at once, as if they came one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.session import stored

SUFFIX = "^(.*)-([1-9][0-9]*)$"


def _blocks(taken: DataFrame) -> DataFrame:
    """(base, place, free) of taken names: each as a place of its base (the name itself is 1, its n-th form n), and the next place that isn't taken."""
    number = F.regexp_extract("name", SUFFIX, 2)
    first = taken.select(F.col("name").alias("base"), F.lit(1).cast("long").alias("place"))
    formed = taken.where((number != "") & (F.length(number) <= 9)).select(F.regexp_extract("name", SUFFIX, 1).alias("base"), number.cast("long").alias("place")).where("place >= 2")
    order = Window.partitionBy("base").orderBy("place")
    runs = first.unionByName(formed).distinct().withColumn("run", F.col("place") - F.row_number().over(order))
    return runs.withColumn("free", F.max("place").over(Window.partitionBy("base", "run")) + 1).select("base", "place", "free")


def unique_names(requests: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, base, name): each request, in the order of `id`, gets its base, or the first of base-2, base-3 and so on that is neither taken nor given before.

    requests: id, base. taken: name. All requests ask at once for the first place that can still be theirs, and each name goes to the
    earliest that asks for it; the others ask for their next place, until nobody has to. As every name prefers the earlier request, that
    is what one after the other would get. Requests of one base stay in order, so each round moves all of them on together.
    """
    blocked = stored(_blocks(taken.select("name").distinct()))
    order = Window.partitionBy("base").orderBy("id")
    asked = stored(requests.select("id", "base").withColumn("nth", F.row_number().over(order).cast("long")).withColumn("place", F.col("nth")))
    name = F.when(F.col("place") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("place").cast("string")))
    while True:
        # What is taken: the next free place after the block.
        free = asked.join(blocked, ["base", "place"], "left").withColumn("to", F.coalesce("free", "place"))
        # A name may be asked for under several bases, as x and 2, or as x-2 and 1.
        winner = F.min("id").over(Window.partitionBy("name"))
        held = free.withColumn("name", name).withColumn("to", F.when((F.col("to") == F.col("place")) & (F.col("id") != winner), F.col("place") + 1).otherwise(F.col("to")))
        moved = held.withColumn("place", F.col("nth") + F.max(F.col("to") - F.col("nth")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        now = stored(moved.select("id", "base", "nth", "place", (F.col("place") != F.col("nth")).alias("later")))
        same = now.join(asked.select("id", F.col("place").alias("before")), "id").where("place <> before").isEmpty()
        asked = now.drop("later")
        if same:
            return asked.select("id", "base", name.alias("name"))
