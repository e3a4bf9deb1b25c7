"""Places and running totals within groups of any size, without a task that has a whole group.

Rows are dealt to ranges of (group, order) and written with the number of their range. Within a range a window gives places
and totals; what the ranges before it add to each group is a row for each range and group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm.common import stored

RANGE = "_range"


def in_ranges(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The rows, written by ranges of group and order, with the range's number in `_range`.

    Rows that agree in both come by the place in which they were read, so that not even those have to fit in one range.
    """
    marked = rows.withColumn("_row", F.monotonically_increasing_id())
    return stored(stored(marked).repartitionByRange(*group, *order, "_row").withColumn(RANGE, F.spark_partition_id()))


def running(ranged: DataFrame, group: list[str], order: list[str], **totals: tuple[str, Column]) -> DataFrame:
    """Adds running totals, the row's own value included: `name=("sum" or "bit_xor", value)`. Other columns of the ranges stay."""
    how = {name: (getattr(F, f), start) for name, (f, _) in totals.items() for start in (0,)}
    valued = ranged.select("*", *(value.alias(f"_v_{name}") for name, (_, value) in totals.items()))
    whole = valued.groupBy(RANGE, *group).agg(*(f(f"_v_{name}").alias(f"_t_{name}") for name, (f, _) in how.items()))
    before = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(
        F.col(RANGE).alias("_c_range"), *(F.col(g).alias(f"_c_{g}") for g in group), *(F.coalesce(f(f"_t_{name}").over(before), F.lit(start)).cast("long").alias(f"_b_{name}") for name, (f, start) in how.items())
    )
    same = reduce(lambda x, g: x & F.col(g).eqNullSafe(F.col(f"_c_{g}")), group, F.col(RANGE) == F.col("_c_range"))
    within = Window.partitionBy(RANGE, *group).orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, 0)
    placed = valued.select("*", *(f(f"_v_{name}").over(within).alias(f"_w_{name}") for name, (f, _) in how.items()))
    joined = placed.join(carried, same)
    sums = [(F.col(f"_b_{name}") + F.col(f"_w_{name}") if totals[name][0] == "sum" else F.col(f"_b_{name}").bitwiseXOR(F.col(f"_w_{name}"))).alias(name) for name in totals]
    return joined.select(*ranged.columns, *sums)


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "place") -> DataFrame:
    """The rows with their place in the group, from 0; nulls come first."""
    ranged = in_ranges(rows, group, order)
    return running(ranged, group, order, **{name: ("sum", F.lit(1).cast("long"))}).withColumn(name, F.col(name) - 1).drop("_row", RANGE)
