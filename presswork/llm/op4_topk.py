"""Operator 4: exact top-k search by inner product, pruned with multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments; each segment has a mean and a deviation. For two segments of n
components the inner product is at most n * (mean * mean' + deviation * deviation'), so the sum over segments
bounds the score from above (with fixed norms this is the lower bound of the distance). Bounds are taken from
coarse to fine, a level only for pairs that the one before left; survivors get their exact score.

Vectors are dealt in blocks of bounded size. Each query first searches the block that it lives in, which gives
its k-th best score so far; then every block of queries meets every block of candidates in a task of its own
and gives only rows that reach those scores. A ranking over the rows of each query ends it.

Nulls and odd input: rows with a null id, a null vector, or a null or non-finite component take no part, and
vectors meet only vectors of their own length. Rows that repeat a query's id aren't its candidates, and have one ranking
with it. Ties go to the smaller id. Scores are exact integers as long as they fit into 64 bits, however large the
products that they are sums of. An empty table gives an empty table. Only the id and the vector are read, so other
columns' names don't matter; a vector's length is bounded by memory alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm.common import table

LEVELS = (1, 4, 16)
BLOCK = 1024
SCALE = 64
_CELL = "query_id long, vec_id long, score long"


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means, then deviations, of each vector's segments, times the root of the segment's length."""
    width = vectors.shape[1]
    edges = np.unique(np.linspace(0, width, min(segments, max(width, 1)) + 1).astype(np.int64))
    parts = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = vectors[:, low:high]
        parts.append((part.mean(axis=1) * np.sqrt(high - low), part.std(axis=1) * np.sqrt(high - low)))
    return np.array([m for m, _ in parts] + [s for _, s in parts]).T.reshape(len(vectors), -1)


LOWEST = np.iinfo(np.int64).min


def _levels(vectors: np.ndarray) -> list[np.ndarray]:
    """Statistics of each level, and a share of the vector's norm, which makes each bound larger than its rounding errors."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return [np.concatenate([segment_statistics(vectors, s), norm * 10**-4.5], axis=1) for s in LEVELS]


def search(query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query, candidate, score) that may be among a query's k best: those of the k best here that reach the query's floor.

    Queries and vectors are integers. Floors are scores, or LOWEST.
    """
    q, v = queries.astype(np.float64), vectors.astype(np.float64)
    ours, theirs = _levels(q), _levels(v)
    # Doubles hold each sum of products up to this; beyond, integers that wrap around end in the right sum.
    small = q.shape[1] * np.abs(q).max(initial=0) * np.abs(v).max(initial=0) < 2**53
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for low in range(0, len(queries), 128):
        own = slice(low, low + 128)
        same = query_ids[own, None] == ids[None, :]
        bound = ours[0][own] @ theirs[0].T
        bound[same] = -np.inf
        # Exact scores of the most promising pairs raise the floor before anything is pruned.
        first = min(2 * k, len(ids))
        likely = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        score = (np.einsum("qcd,qd->qc", v[likely], q[own]) if small else np.einsum("qcd,qd->qc", vectors[likely], queries[own])).astype(np.int64)
        score[np.take_along_axis(same, likely, axis=1)] = LOWEST
        floor = floors[own].copy()
        if first >= k:
            floor = np.maximum(floor, np.partition(score, first - k, axis=1)[:, first - k])
        least = np.where(floor == LOWEST, -np.inf, floor.astype(np.float64))
        alive = (bound >= least[:, None]) & ~same
        rows, columns = np.nonzero(alive)
        for level in range(1, len(LEVELS)):
            if len(rows) * 8 > alive.size:
                fine = (ours[level][own] @ theirs[level].T)[rows, columns]
            else:
                fine = np.einsum("pd,pd->p", ours[level][own][rows], theirs[level][columns])
            keep = fine >= least[rows]
            rows, columns = rows[keep], columns[keep]
        if not small:
            exact = np.einsum("pd,pd->p", queries[own][rows], vectors[columns])
        elif len(rows) * 8 > alive.size:
            exact = (q[own] @ v.T)[rows, columns].astype(np.int64)
        else:
            exact = np.einsum("pd,pd->p", q[own][rows], v[columns]).astype(np.int64)
        keep = exact >= floor[rows]
        rows, columns, exact = rows[keep], columns[keep], exact[keep]
        # Best first; ~ turns the order of integers around without overflow.
        order = np.lexsort((ids[columns], ~exact, rows))
        rows, columns, exact = rows[order], columns[order], exact[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = place < k
        out.append((query_ids[own][rows[best]], ids[columns[best]], exact[best]))
    return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, dtype=np.int64) for i in range(3))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def _ints(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def _home(k: int):
    def run(group: pa.Table) -> pa.Table:
        queries = group.filter(group["is_query"])
        ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if queries.num_rows:
            none = np.full(queries.num_rows, LOWEST)
            ids, _, scores = search(_ints(queries["vec_id"]), _matrix(queries["v"]), none, _ints(group["vec_id"]), _matrix(group["v"]), k)
        # Rows of a query are together and best first; its floor is the k-th, if there are so many.
        names, first, count = np.unique(ids, return_index=True, return_counts=True)
        full = count >= k
        return pa.table({"vec_id": pa.array(names[full]), "floor": pa.array(scores[first[full] + k - 1])})

    return run


def _cell(k: int):
    def run(group: pa.Table) -> pa.Table:
        side = group["is_query"]
        queries, others = group.filter(side), group.filter(pa.compute.invert(side))
        found = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
        if queries.num_rows and others.num_rows:
            floors = queries["floor"].fill_null(int(LOWEST)).to_numpy()
            found = search(_ints(queries["vec_id"]), _matrix(queries["v"]), floors, _ints(others["vec_id"]), _matrix(others["v"]), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The k best rows of each query: query_id, rank, vec_id, score. `is_query`: a condition on `vec_id`, as a function of its column."""
    x = F.col("raw")
    whole = F.forall("raw", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    usable = (
        vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("raw"))
        .where(F.col("vec_id").isNotNull() & x.isNotNull() & whole)
        .select("vec_id", F.transform("raw", lambda e: F.floor(e * SCALE)).alias("v"), is_query(F.col("vec_id")).alias("is_query"))
        .withColumn("width", F.size("v"))
    )
    n, asked = usable.agg(F.count("*"), F.count_if("is_query")).first()
    blocks, asking = max(1, -(-n // block)), max(1, -(-asked // block))
    dealt = usable.withColumn("home", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    floors = dealt.groupBy("width", "home").applyInArrow(_home(k), "vec_id long, floor long").dropDuplicates(["vec_id"])
    queries = (
        dealt.where("is_query")
        .join(floors, "vec_id", "left")
        .select(
            "vec_id", "v", "width", "floor", F.lit(True).alias("is_query"), F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(asking)).cast("int").alias("asker"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("home")
        )
    )
    others = dealt.select("vec_id", "v", "width", F.lit(None).cast("long").alias("floor"), F.lit(False).alias("is_query"), F.explode(F.sequence(F.lit(0), F.lit(asking - 1))).alias("asker"), "home")
    found = queries.unionByName(others).groupBy("width", "asker", "home").applyInArrow(_cell(k), _CELL)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
