"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import stored

#: Tasks among which a node's neighbours are dealt.
PARTS = 8
#: Edges from which on the join with nodes' least neighbours is by shuffles.
MANY = 1 << 14


def components(links: DataFrame) -> DataFrame:
    """For links (a, b) of longs: (node, root), the root being the smallest node that `node` reaches. Roots themselves aren't listed.

    Every node passes its smallest neighbour on to its larger neighbours, then to its smaller ones, until
    nothing changes; the number of rounds grows as the logarithm of the longest path. The neighbours of a node with
    very many of them are dealt to several tasks. Nothing but two sums comes to the driver: Spark's size check for broadcasts
    doesn't see that each node's least neighbour is there once for each of these tasks, so with many edges that isn't left to it.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    before, rows = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        spread = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        dealt = both.where("v > u").withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))
        large = dealt.join(spread.hint("merge") if rows > MANY else spread, ["u", "part"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        smaller = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smaller, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = stored(small.unionByName(smaller.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, rows = now, now[0]
