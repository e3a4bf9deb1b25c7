"""Operator 12: a Merkle manifest of a dataset, reduced superblock by superblock, with a proof for every row.

A leaf is the hash of its row's columns. The leaves of each group (a source) ascend by id; while several nodes remain, every
`fanout` consecutive ones become the hash of their concatenation. The groups' roots, in the order of the groups, give
the root of the dataset likewise.

1. Each leaf gets its place in its group, by ranges of rows; a group may have any share of all rows.
2. Places are dealt to buckets of fanout ** k consecutive ones. `applyInPandas` collapses the k levels of each bucket, so the
   table that comes next is fanout ** k times smaller; its rows, with the bucket as their place, are reduced in the same way
   until one node of each group remains. Every bucket has the rows of its places only, so no task has a whole group.
3. The groups' roots are ranked and reduced in the same way.
4. Going down again (`applyInArrow`, which leaves carried columns as they are), each bucket's rows meet the one proof that the bucket has above: what a row has for its own k levels, then
   that. Only the leaves' step makes a row for each document.

A proof is two strings: `shape` has two digits a level, the node's place in its run and how many nodes the run has, and
`siblings` has the digests of the run's others, level by level. `fold` computes a root from a leaf and its proof.

Nulls and odd input: a null column counts as `-` and differs from any text. Null groups and null ids come first. Rows that
repeat an id are ordered by their leaf, and equal rows are leaves of their own next to each other. A lone leaf is its group's
root, and a lone group's root is the dataset's; their proofs are empty. Texts of any length are hashed by Spark, not
copied. An empty table gives an empty table. Of `docs` only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import stored, table
from presswork.llm.ranks import numbered

FANOUT = 3
#: Levels of a superblock: 2,187 places.
LEVELS = 7
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_of(*columns: Column) -> Column:
    """The digest of a row: each column as `-`, or as its length in bytes, a colon and its text."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, shape: Column, siblings: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    digit = lambda i: F.substring(shape, i, F.lit(1)).cast("int")
    steps = F.when(F.length(shape) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.length(shape) - 1, F.lit(1)), F.lit(2)))

    def step(state: Column, i: Column) -> Column:
        place, others, at = digit(i), digit(i + 1) - 1, state["at"]
        before = F.substring(siblings, at, place * 64)
        after = F.substring(siblings, at + place * 64, (others - place) * 64)
        return F.struct(F.sha2(F.concat(before, state["node"], after), 256).alias("node"), (at + others * 64).alias("at"))

    return F.aggregate(steps, F.struct(leaf.alias("node"), F.lit(1).alias("at")), step)["node"]


def _run(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def collapse(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The levels of a bucket, its own nodes first; at most `levels` more, each by runs of `fanout`."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([_run(last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return out


def levels_of(count: int, levels: int, fanout: int) -> int:
    """How many levels a bucket has: all of them while its group goes on beyond it, else until one node remains."""
    used = 0
    while used < levels and count > 1:
        count, used = -(-count // fanout), used + 1
    return used


def proofs(tree: list[list[str]], fanout: int) -> tuple[list[str], list[str]]:
    """(shapes, siblings) of each node of the lowest level up to the top of the bucket."""
    # What a node's ancestors add is made once for each of them, from the top down.
    shapes, siblings = [""] * len(tree[-1]), [""] * len(tree[-1])
    for below in reversed(tree[:-1]):
        s, o = [], []
        for i in range(len(below)):
            run = below[i - i % fanout : i - i % fanout + fanout]
            s.append(f"{i % fanout}{len(run)}{shapes[i // fanout]}")
            o.append("".join(run[: i % fanout] + run[i % fanout + 1 :]) + siblings[i // fanout])
        shapes, siblings = s, o
    return shapes, siblings


def _up(levels: int, fanout: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        top = collapse(rows["node"].tolist(), levels_of(int(rows["n"].iloc[0]), levels, fanout), fanout)[-1]
        return pd.DataFrame({"g": rows["g"].iloc[:1], "place": rows["bucket"].iloc[:1], "node": top})

    return run


def _down(levels: int, fanout: int, columns: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        shapes, siblings = [], []
        if rows.num_rows:
            shapes, siblings = proofs(collapse(rows["node"].to_pylist(), levels_of(rows["n"][0].as_py(), levels, fanout), fanout), fanout)
            shape, sibling = above["shape"][0].as_py(), above["siblings"][0].as_py()
            shapes, siblings = [x + shape for x in shapes], [x + sibling for x in siblings]
        return pa.Table.from_arrays([*(rows[c] for c in columns), pa.array(shapes, pa.string()), pa.array(siblings, pa.string())], names=[*columns, "shape", "siblings"])

    return run


def _bucketed(nodes: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    return nodes.join(counts, "g").withColumn("bucket", F.floor(F.col("place") / size))


def tree(nodes: DataFrame, keep: list[str] = (), levels: int = LEVELS, fanout: int = FANOUT, above: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(g, node) of each group's root; and the nodes with `keep`, shape and siblings, up to the group's root and on through `above`.

    nodes: g (a long), place (from 0), node (a digest), and the columns of `keep`. `above` is given the roots and returns their own
    (g, shape, siblings).
    """
    size = fanout**levels
    floors, now = [], nodes
    while True:
        counts = stored(now.groupBy("g").agg(F.count("*").alias("n")))
        floors.append((now, counts))
        if not counts.where("n > 1").take(1):
            break
        kind = "g long, place long, node string"
        top = _bucketed(now.select("g", "place", "node"), counts, size).groupBy("g", "bucket").applyInPandas(_up(levels, fanout), kind)
        now = stored(top)
    roots = now.select("g", "node")
    upper = roots.select("g", F.lit("").alias("shape"), F.lit("").alias("siblings")) if above is None else above(roots)
    proof = upper.withColumn("bucket", F.lit(0).cast("long"))
    for depth, (rows, counts) in reversed(list(enumerate(floors[:-1]))):
        own = ["g", "place", "node", *(keep if depth == 0 else [])]
        named = _bucketed(rows.select(*own), counts, size)
        kinds = ", ".join(f"`{c}` {named.schema[c].dataType.simpleString()}" for c in own)
        met = named.groupBy("g", "bucket").cogroup(proof.groupBy("g", "bucket")).applyInArrow(_down(levels, fanout, own), f"{kinds}, shape string, siblings string")
        proof = met if depth == 0 else stored(met).select("g", F.col("place").alias("bucket"), "shape", "siblings")
    if len(floors) == 1:
        proof = nodes.join(upper, "g").select("g", "place", "node", *keep, "shape", "siblings")
    return roots, proof


def merkle_manifest(leaves: DataFrame, group: str = "source", order: str = "doc_id", keep: list[str] = (), levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """Rows with their `leaf`, subroot, root, shape and siblings, and the columns `group`, `order` and `keep`.

    `leaves` has the column `leaf` (see `leaf_of`), the group and the order; fanout at most 9.
    """
    columns = [group, order, *(c for c in keep if c not in (group, order, "leaf"))]
    named = leaves.select(F.col("leaf").alias("node"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(columns)))
    placed = numbered(named, ["k0"], ["k1", "node"])
    # A group's number is its place among the groups, so that groups of any name (or none) are joined by a long.
    groups = stored(numbered(placed.select("k0").distinct(), [], ["k0"], "g"))
    nodes = stored(placed.join(groups.withColumnRenamed("k0", "name"), F.col("k0").eqNullSafe(F.col("name"))).drop("name"))
    tops: dict[str, DataFrame] = {}

    def above(subroots: DataFrame) -> DataFrame:
        rows = stored(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("place"), "node"))
        root, proof = tree(rows, levels=levels, fanout=fanout)
        tops["root"] = root
        tops["subroots"] = rows.select(F.col("place").alias("g"), F.col("node").alias("subroot"))
        return stored(proof.select(F.col("place").alias("g"), "shape", "siblings"))

    _, proved = tree(nodes, [f"k{i}" for i in range(len(columns))], levels, fanout, above)
    root = tops["root"].first()  # the one digest of the dataset
    out = proved.join(tops["subroots"], "g").withColumn("root", F.lit(root.node if root else None).cast("string"))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(columns)), F.col("node").alias("leaf"), "subroot", "root", "shape", "siblings")


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    columns = [F.col(c) for c in COLUMNS]
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    cut = leaf_of(*columns[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    leaves = docs.select("doc_id", "source", leaf_of(*columns).alias("leaf"), F.when(changed & F.contains("text", F.lit("\n")), cut).alias("tampered"))
    out = merkle_manifest(leaves, keep=["tampered"])
    folded = out.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("shape"), F.col("siblings")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
