"""Operator 7: n-gram Jaccard join, size-aware, with light and heavy sets.

A document's set is its distinct shingles of five words (as 64-bit hashes); two documents link when
100 * intersection >= 80 * union. The result has a row for each document with its component.

1. Documents of equal sets become one class, by a 128-bit sum over the set.
2. A set of n has at most n - ceil(0.8 n) shingles that a partner lacks. Shingles in a fixed 0.3 of the hash space
   are counted over all classes; a class with more shingles of its own than that has no partner, and goes no
   further. This is exact: it only leaves out what can't link.
3. The shingles of the remaining sets are ordered from rare to common. A pair that links shares a shingle
   among the first n - ceil(0.8 n) + 1 of both sets, and two among one more.
   - Light sets (up to a boundary size) give all subsets of two of that longer prefix as keys.
   - Heavy sets are entered in the inverted lists of their prefix. Sets from 0.8 of the boundary up are in these
     lists too, so pairs across the boundary are found.
   The boundary is the size at which the sum of both costs (subsets made, list entries) is least.
4. Sets that share a key are compared with two pivots of the key. Sets that are in one component by then need no
   further comparison, so a group of copies costs a row each, not a pair each. Step 3 is done again for the sets
   that still share a key with another component, shingles that only one component has being out of play.
5. What is left is compared turn by turn: each set with the smallest of its key and with a few others of it at random.
   What links is joined; keys of one component leave, as do rows whose remaining shared shingles can't reach the
   threshold with any size in their key. A set that links with a good part of its key is found in a few turns.
6. A key that then still has many sets is cut into narrower ones. Each set is told by its difference from the smallest of
   the key, so what nearly all have in common no longer counts, and a shingle that nearly all have but this set lacks
   does. Differences of sets that link share all but few shingles; the same rule as in step 3, with subsets of a size that
   the cost decides, makes the narrower keys. That is exact as well. Turns are taken with these keys, too.
7. Pairs of different components that share a key in the end are tested, which makes it exact. Bitmaps and the places of
   the key tell how large the intersection can be at most; only pairs that may link leave the join, to be compared by their
   whole sets. Keys up to CROWD rows cost a few tests for each row.

Nulls and odd input: a document without words or text has an empty set and links with nothing. With fewer
than five words the whole sequence is the one shingle. Rows that repeat a doc_id keep a row each. A null doc_id
is kept; a component's id is the smallest doc_id that isn't null. Very long texts are read in one piece, with some
twenty times their size in memory. An empty table gives an empty table. Of `docs` only the id and the text are read, so
other columns' names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm.common import stored, table
from presswork.llm.graphs import components
from presswork.llm.textarrays import lower_ascii, mix, ragged, run_hashes, slices, span_hashes, stretch_hashes, utf8, word_spans

WORDS = 5
#: Of the hash space, what is counted in step 2. Over 0.2, or nothing would be left out.
COUNTED = 0.3
#: Pairs for each row of open keys, up to which the pairs are tested one by one: at once, and after a turn. A turn compares
#: whole sets, a test only bitmaps, so turns begin where there are many pairs.
MANY, FEW = 64, 4
#: Others that a set of an open key is compared with in a turn, out of a group of so many.
PARTNERS, GROUP = 4, 64
#: Rows of a key from which on narrower keys are made in it, if there are more than half as many pairs for each row.
CROWD = 32
#: Subsets that a set may make for one pair of classes, if they are of two shingles or more.
SUBSETS = 24


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct shingles in ascending order, and where each row's begin."""
    starts, ends, rows = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    count = np.diff(rows)
    runs = run_hashes(words, k)
    many = np.maximum(count - k + 1, 0)
    row = np.repeat(np.arange(len(count)), many)
    hashes = runs[ragged(rows[:-1], many)]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        row = np.concatenate([row, few])
        hashes = np.concatenate([hashes, stretch_hashes(words, rows[few], rows[few + 1])])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[new], hashes[new]
    return hashes, np.searchsorted(row, np.arange(len(count) + 1))


def _sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _names(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set that don't depend on order."""
    return mix(_sum(mix(hashes ^ np.uint64(0x51)), at)).view(np.int64), mix(_sum(mix(hashes ^ np.uint64(0xA7)), at)).view(np.int64)


def _rows(batch: pa.RecordBatch, column: int, k: int):
    """(first row, hashes, where each row's begin) for slices of the batch."""
    all_data, all_offsets = utf8(batch.column(column))
    for first, last in slices(all_offsets):
        yield first, *shingle_sets(lower_ascii(all_data[all_offsets[first] : all_offsets[last]]), all_offsets[first : last + 1] - all_offsets[first], k)


def _profile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, at in _rows(batch, 1, k):
                s, s2 = _names(hashes, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(s)), pa.array(np.diff(at)), pa.array(s), pa.array(s2)], names=["id", "n", "s", "s2"])

    return run


def _counted(k: int):
    limit = np.uint64(int(COUNTED * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes, at in _rows(batch, 0, k):
                s = np.repeat(_names(hashes, at)[0], np.diff(at))
                keep = hashes < limit
                yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), pa.array(s[keep])], names=["shingle", "s"])

    return run


def _whole(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, wanted2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for first, hashes, at in _rows(batch, 0, k):
                s, s2 = _names(hashes, at)
                right = np.flatnonzero((s == wanted[first : first + len(s)]) & (s2 == wanted2[first : first + len(s)]))
                size = np.diff(at)[right]
                values = pa.array(hashes[ragged(at[right], size)].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([pa.array(s[right]), pa.array(size), lists], names=["s", "n", "shingles"])

    return run


def _slack(n):
    """How many shingles of a set a partner may lack."""
    return n - F.floor((n * 4 + 4) / 5)


def _keys(prefixes: DataFrame, boundary: int) -> DataFrame:
    """(key, s, n, rest) of light and heavy sets. `rest`: of the set's shared shingles, how many are left from the key's first one on.

    If a key is the first in order that two sets share, their intersection is within both `rest`.
    """
    pairs = F.flatten(F.transform("front", lambda x, i: F.transform(F.slice("front", i + 2, F.greatest(F.size("front") - i - 1, F.lit(0))), lambda y: F.struct(F.xxhash64(x, y).alias("key"), (F.col("shared") - i).alias("rest")))))
    light = prefixes.where(F.col("n") <= boundary).select(F.explode(pairs).alias("k"), "s", "n").select("k.key", "s", "n", "k.rest")
    long = prefixes.where(F.col("n") * 5 >= F.lit(4 * boundary))
    heavy = long.select(F.posexplode(F.slice("front", 1, F.col("single"))).alias("i", "key"), "s", "n", "shared").select("key", "s", "n", (F.col("shared") - F.col("i")).alias("rest"))
    return light.unionByName(heavy)


def _may_link(n1: Column, rest1: Column, n2: Column, rest2: Column) -> Column:
    """Whether the intersection can be 0.8 of the union at all: it is at most `rest`, and must be 4/9 of both sizes."""
    return F.least(rest1, rest2) * 9 >= (n1 + n2) * 4


def _bitmap(shingles: Column) -> Column:
    """1,024 bits, as 16 longs, of which a set has one on for each shingle."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(x, 4), F.lit(64)).cast("int"))
    word = lambda w: F.aggregate(shingles, F.lit(0).cast("long"), lambda t, x: t.bitwiseOR(F.when(F.pmod(x, F.lit(16)) == w, bit(x)).otherwise(F.lit(0).cast("long"))))
    return F.array(*map(word, range(16)))


def _lacking(first: str, second: str) -> Column:
    """Bits that only the first map has on: at least so many of its shingles the other set lacks."""
    return F.aggregate(F.zip_with(first, second, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda t, v: t + v)


def _boundary(prefixes: DataFrame) -> int:
    """The size up to which sets are light, by powers of two: where the rows that they make, as subsets or as list entries, are fewest.

    A list entry counts double, since sets that share one shingle are less often near copies than sets that share two.
    """
    step = F.ceil(F.log2(F.col("n").cast("double")))
    size = F.size("front").cast("double")
    costs = prefixes.groupBy(step.alias("step")).agg(F.sum(size * (size - 1) / 2).alias("light"), F.sum(F.col("single") * 2).alias("heavy")).orderBy("step").collect()
    best, choice = sum(c.heavy for c in costs), 0
    for c in costs:  # one for each power of two
        cost = sum(x.light for x in costs if x.step <= c.step) + sum(x.heavy for x in costs if x.step >= c.step)
        if cost < best:
            best, choice = cost, 2**c.step
    return choice


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, and any other columns) that link, by their whole sets."""
    first = sets.select(F.col("s").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("s").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(first, "a").join(second, "b").where(common * 100 >= (F.col("na") + F.col("nb") - common) * 80).select(*pairs.columns)


def _prefixes(rows: DataFrame) -> DataFrame:
    """Of each set its shingles (`own`), rare ones first, without those that only its own component has.

    rows: s, n, shingle, df of shared shingles, df being the number of components that have it. `single`: how many
    of `front` belong to the prefix of which a partner must share one; the whole `front` is one longer.
    """
    ordered = rows.groupBy("s", "n").agg(F.sort_array(F.collect_set(F.struct("df", "shingle"))).alias("own"))
    # Shingles of one component come first of all, and can't be shared with another.
    short = F.col("n").cast("long") - F.size("own")
    single = F.greatest(_slack(F.col("n")) + 1 - short, F.lit(0)).cast("int")
    cut = ordered.select("s", "n", "own", single.alias("single")).where("single > 0")
    return cut.select("s", "n", F.expr("transform(own, x -> x.shingle)").alias("own"), F.size("own").alias("shared"), F.least("single", F.size("own")).alias("single"), F.expr("transform(slice(own, 1, single + 1), x -> x.shingle)").alias("front"))


def _keyed(active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes and keys (key, s, n, rest, c) of sets (s, n, shingles, and their component c)."""
    rows = active.select("s", "n", "c", F.explode("shingles").alias("shingle"))
    shared = rows.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("df")).where("low < high").select("shingle", "df")
    prefixes = stored(_prefixes(rows.join(shared, "shingle").select("s", "n", "shingle", "df")))
    return prefixes, stored(_keys(prefixes, _boundary(prefixes)).join(active.select("s", "c").distinct(), "s"))


def _open(keys: DataFrame) -> DataFrame:
    """The rows of keys that hold two components, less those that can link with no size that their key has; with the key's rows (g) and its smallest set (hub)."""
    hub = F.min_by(F.struct("s", "n", "rest", "c"), F.struct("n", "s"))
    key = keys.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("n").alias("least"), F.max("rest").alias("most"), F.count("*").alias("g"), hub.alias("hub")).where("low < high")
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * 4 / 5))
    return keys.join(key, "key").where(_may_link(F.col("n"), F.col("rest"), partner, F.col("most"))).select("key", "s", "n", "rest", "c", "side", "g", "hub")


def _pairs_of_keys(keys: DataFrame) -> DataFrame:
    """(key, rows, pairs): how many pairs of different components, and of different sides where there are two, each key has."""
    on = lambda bit: F.count_if(F.col("side").bitwiseAND(bit) > 0)
    many = keys.groupBy("key", "c").agg(F.count("*").alias("g"), on(1).alias("x"), on(2).alias("y"), F.max("side").alias("side"))
    sums = many.groupBy("key").agg(F.sum("g").alias("rows"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("same"), F.max("side").alias("side"))
    both = F.col("x") * F.col("y") - F.col("same")
    return sums.select("key", "rows", F.when(F.col("side") == 3, both / 2).otherwise(both).cast("long").alias("pairs")).where("pairs > 0")


def _met(rows: DataFrame, other: str) -> DataFrame:
    """(a, b, and their components) of each set with the one in the column `other`, where they may link."""
    met = rows.where((F.col("c") != F.col(f"{other}.c")) & _may_link(F.col("n"), F.col("rest"), F.col(f"{other}.n"), F.col(f"{other}.rest")))
    first = F.col("s") < F.col(f"{other}.s")
    side = lambda name, one, two: F.when(first, F.col(one)).otherwise(F.col(two)).alias(name)
    return met.select(side("a", "s", f"{other}.s"), side("b", f"{other}.s", "s"), side("ca", "c", f"{other}.c"), side("cb", f"{other}.c", "c"))


def _with_ends(keys: DataFrame) -> DataFrame:
    """Each set with the first and last of its keys."""
    pivot = F.struct("s", "n", "rest", "c")
    ends = keys.groupBy("key").agg(F.min(pivot).alias("one"), F.max(pivot).alias("two"))
    return _met(keys.join(ends.select("key", F.explode(F.array("one", "two")).alias("p")), "key"), "p").distinct()


def _with_partners(rows: DataFrame, turn: int) -> DataFrame:
    """Each set with the smallest of its key and with a few others, which are others in each turn.

    A key's sets are dealt at random to groups of a fixed size, so no task has all of a common key.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("s", F.lit(turn)), F.ceil(F.col("g") / GROUP)))
    order = Window.partitionBy("key", "part").orderBy(F.xxhash64("s", F.lit(-turn)), "s")
    others = F.array(*(F.lag(F.struct("s", "n", "rest", "c"), k).over(order) for k in range(1, PARTNERS + 1)), F.col("hub"))
    return _met(dealt.withColumn("others", others).select("s", "n", "rest", "c", F.explode("others").alias("p")).where("p IS NOT NULL"), "p").distinct()


def _differences(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows, with what tells each set from the smallest of its key: `left`, the shingles of that symmetric difference which
    a set of another component also has in its own (rare ones first), and `budget`, nine times what `left` of two sets may differ
    by on this set's side.

    Two sets link if their symmetric difference has at most a ninth of the sum of both sizes. It is the symmetric difference
    of their differences from the smallest set, of which no other can have the shingles that aren't in `left`.
    """
    hub = sets.select(F.col("s").alias("h"), F.col("shingles").alias("of_hub"))
    met = rows.select("key", "s", "n", "rest", "c", F.col("hub.s").alias("h")).join(sets.select("s", "shingles"), "s").join(hub, "h")
    far = stored(met.select("key", "s", "n", "rest", "c", F.concat(F.array_except("shingles", "of_hub"), F.array_except("of_hub", "shingles")).alias("far")))
    each = far.select("key", "s", "c", F.explode("far").alias("x"))
    shared = each.groupBy("key", "x").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("df")).where("low < high").select("key", "x", "df")
    left = each.select("key", "s", "x").join(shared, ["key", "x"]).groupBy("key", "s").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("left"))
    kept = F.coalesce(F.expr("transform(left, e -> e.x)"), F.array().cast("array<long>"))
    return far.join(left, ["key", "s"], "left").select("key", "s", "n", "rest", "c", kept.alias("left"), (F.col("n") - (F.size("far") - F.size(kept)) * 9).alias("budget"))


def _subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row (key, s, n, rest, c, side, name, take, k, left) a key for each subset of k of the first `take` in `left`."""
    chosen = lru_cache(maxsize=1000)(lambda m, k: np.array(list(combinations(range(m), k)), dtype=np.int64).reshape(comb(m, k), k))
    for batch in batches:
        name, take, k = (batch.column(i).to_numpy() for i in (6, 7, 8))
        lists, keys, source, many = batch.column(9), [], [], 0
        at, x = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        for row in range(len(name) + 1):
            if keys and (row == len(name) or many > 500_000):
                rest = batch.take(pa.array(np.repeat(np.array(source), [len(some) for some in keys])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(rest.column(i) for i in range(1, 6))], names=["key", "s", "n", "rest", "c", "side"])
                keys, source, many = [], [], 0
            if row < len(name):
                front = mix(x[at[row] : min(at[row + 1], at[row] + take[row])])
                made = mix(front[chosen(len(front), k[row])].sum(axis=1, dtype=np.uint64) ^ mix(name[row : row + 1].view(np.uint64)))
                if len(made):
                    keys.append(made)
                    source.append(row)
                    many += len(made)


def _choose(n: Column, k: int) -> Column:
    """The subsets of k that n have."""
    return reduce(lambda x, i: x * (n - i) / (i + 1), range(k), F.lit(1.0))


def _finer(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Narrower keys (key, s, n, rest, c, side) for the rows of crowded keys: any two sets of one key that link share one.

    If two sets' `left` may differ by e shingles, they share (|a| + |b| - e) / 2, all but t = (|a| - |b| + e) / 2 of a's. So the
    first k of what they share are a subset of the first t + k of each. Sets are classed by the power of two that holds their
    budget and by the size of `left`; each pair of classes has its own k: the largest that makes few subsets, and at most what any
    pair of them shares. Classes with few pairs, or of which a pair may share nothing, have one key. `side`: 1 or 2 for the sets
    of different classes, which are held against each other only, else 3.
    """
    size = F.size("left").cast("long")
    level = F.ceil(F.log2(F.greatest(F.col("budget") / 9.0, F.lit(1.0)))).cast("int")
    width = F.pow(F.lit(2.0), F.greatest(level, F.floor(F.log2(size + 1.0)) - 4))
    far = stored(_differences(rows, sets).withColumn("kind", F.struct(level.alias("level"), width.alias("width"), F.floor(size / width).alias("step"))))
    kinds = stored(far.groupBy("key", "kind").agg(F.max("budget").alias("top"), F.min(size).alias("least"), F.max(size).alias("most"), F.count("*").alias("g")))
    one, two = (kinds.select("key", *(F.col(x).alias(f"{x}{i}") for x in ("kind", "top", "least", "most", "g"))) for i in (1, 2))
    e = F.floor((F.col("top1") + F.col("top2")) / 9)
    met = one.join(two, "key").where("kind1 <= kind2 AND top1 + top2 >= 0").withColumn("e", e)
    spare = F.floor((F.greatest(F.col("most1") - F.col("least2"), F.col("most2") - F.col("least1")) + F.col("e")) / 2)
    share = F.ceil((F.col("least1") + F.col("least2") - F.col("e")) / 2)
    k = F.when(share < 1, 0).when(F.col("g1") * F.col("g2") <= (F.col("g1") + F.col("g2")) * (CROWD // 4), 0)
    for size_of in (6, 4, 3, 2):
        k = k.when((share >= size_of) & (_choose(spare + size_of, size_of) <= SUBSETS), size_of)
    near = (F.col("least1") - F.col("most2") <= F.col("e")) & (F.col("least2") - F.col("most1") <= F.col("e"))
    met = met.where(near).withColumn("k", k.otherwise(1).cast("long")).withColumn("name", F.xxhash64("key", "kind1", "kind2"))
    view = lambda i, j, side: F.struct(F.col(f"kind{i}").alias("kind"), F.col(f"top{j}").alias("top"), F.col(f"least{j}").alias("least"), "k", "name", side.cast("int").alias("side"))
    same = F.col("kind1") == F.col("kind2")
    both = F.when(same, F.array(view(1, 2, F.lit(3)))).otherwise(F.array(view(1, 2, F.lit(1)), view(2, 1, F.lit(2))))
    placed = far.join(met.select("key", F.explode(both).alias("v")).select("key", "v.*"), ["key", "kind"])
    t = F.floor((size - F.col("least") + F.floor((F.col("budget") + F.col("top")) / 9)) / 2)
    keys = placed.where((F.col("budget") + F.col("top") >= 0) & (t >= 0)).select("key", "s", "n", F.col("rest").cast("long"), "c", "side", "name", (t + F.col("k")).alias("take"), "k", "left")
    return stored(keys.mapInArrow(_subsets, "key long, s long, n long, rest long, c long, side int"))


def _by_turns(keys: DataFrame, sets: DataFrame, seen: list, many: int) -> tuple[DataFrame, int, int, DataFrame | None]:
    """Compares turn by turn what shares a key, as long as that joins much: open rows that remain, how many, their pairs, links found."""
    turn, before, linked = 0, None, None
    while True:
        turn += 1
        rows = stored(_open(keys))
        n, pairs = _pairs_of_keys(rows).agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
        seen.append(("open", n, pairs))
        if pairs <= (many if before is None else FEW) * n or before is not None and pairs > before * 3 / 4:
            return rows, n, pairs, linked
        before = pairs
        near = stored(_with_partners(rows, turn))
        more = stored(_linked(near, sets))
        seen.append(("partners", near.count(), more.count()))
        linked = more.select("a", "b") if linked is None else linked.unionByName(more.select("a", "b"))
        joined = components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        keys = rows.join(joined, rows.c == joined.node, "left").withColumn("c", F.coalesce("root", "c")).select("key", "s", "n", "rest", "c", "side")


def _rest(rows: DataFrame, prefixes: DataFrame, sets: DataFrame, seen: list) -> DataFrame:
    """Links among the pairs that still share a key, tested one by one."""
    mapped = stored(rows.join(prefixes.select("s", "shared", _bitmap(F.col("own")).alias("bits")), "s"))
    one, two = (mapped.select("key", *(F.col(x).alias(f"{x}{i}") for x in ("s", "n", "c", "rest", "shared", "bits", "side"))) for i in (1, 2))
    most = F.least("rest1", F.col("shared1") - _lacking("bits1", "bits2")), F.least("rest2", F.col("shared2") - _lacking("bits2", "bits1"))
    apart = (F.col("s1") < F.col("s2")) & (F.col("c1") != F.col("c2")) & ((F.col("side1") == 3) | (F.col("side1") != F.col("side2")))
    able = _may_link(F.col("n1"), F.col("rest1"), F.col("n2"), F.col("rest2")) & _may_link(F.col("n1"), most[0], F.col("n2"), most[1])
    rest = stored(one.join(two, "key").where(apart & able).select(F.col("s1").alias("a"), F.col("s2").alias("b")).distinct())
    more = stored(_linked(rest, sets))
    seen.append(("rest", rest.count(), more.count()))
    return more


def links(sets: DataFrame, seen: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """(node, root) of all sets in `sets` (s, n, shingles) that link with another one, but the roots.

    `seen` takes (step, rows, pairs) of each step, for tests and logs; `tested` are the pairs that share a key in the end.
    """
    seen = [] if seen is None else seen
    _, keys = _keyed(sets.select("s", "n", "shingles", F.col("s").alias("c")))
    found = stored(_linked(_with_ends(keys), sets).select("a", "b"))
    roots = components(found)
    named = keys.select("key", "s").join(roots, keys.s == roots.node, "left").select("key", "s", F.coalesce("root", "s").alias("c"))
    mixed = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    active = stored(sets.join(named.join(mixed, "key", "left_semi").select("s", "c").distinct(), "s"))
    prefixes, keys = _keyed(active)
    rows, n, pairs, linked = _by_turns(keys.withColumn("side", F.lit(3)), sets, seen, MANY)
    more = [linked] if linked is not None else []
    if pairs > CROWD / 2 * n:
        finer, n, pairs, linked = _by_turns(_finer(rows.where(F.col("g") > CROWD), sets), sets, seen, MANY)
        more += [linked] if linked is not None else []
        small = rows.where(F.col("g") <= CROWD)
        pairs += _pairs_of_keys(small).agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
        rows = small.unionByName(finer)
    seen.append(("tested", n, pairs))
    if pairs:
        more.append(_rest(rows, prefixes, sets, seen))
    for some in more:
        found = found.unionByName(some)
    return components(found) if more else roots


def jaccard_components(docs: DataFrame, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, n_shingles and component_id of each document."""
    picked = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    profile = stored(picked.mapInArrow(_profile(words), f"id {kind}, n long, s long, s2 long"))
    classes = stored(profile.where("n > 0").groupBy("s", "s2", "n").agg(F.min("id").alias("first_id")))
    counted = picked.select("text").mapInArrow(_counted(words), "shingle long, s long")
    alone = counted.groupBy("shingle").agg(F.min("s").alias("s"), F.max("s").alias("other")).where("s = other").groupBy("s").agg(F.count("*").alias("alone"))
    hopeful = classes.join(alone, "s", "left").where(F.coalesce("alone", F.lit(0)) <= _slack(F.col("n"))).select("first_id", "s", "s2")
    none = F.lit(0).cast(kind) if kind != "string" else F.lit("")
    chosen = hopeful.select(F.coalesce("first_id", none).alias("key"), "s", "s2")
    sets = stored(picked.select(F.coalesce("id", none).alias("key"), "text").join(chosen, "key").select("text", "s", "s2").mapInArrow(_whole(words), "s long, n long, shingles array<long>"))
    roots = links(sets)
    named = classes.join(roots, classes.s == roots.node, "left").select("s", "s2", "n", "first_id", F.coalesce("root", "s").alias("c"))
    smallest = named.groupBy("c").agg(F.min("first_id").alias("component_id"))
    labels = named.join(smallest, "c").select("s", "s2", F.col("n").alias("size"), "component_id")
    out = profile.join(labels, (profile.s == labels.s) & (profile.s2 == labels.s2) & (profile.n == labels["size"]), "left")
    return out.select(F.col("id").alias(id_column), profile.n.alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
