"""Operator 11: the prefix trie of conversations, from a merge of sorted runs that carry how much neighbours share.

A node of depth d is a distinct sequence of d turns (role and text); its members are the conversations that begin with it.
The result has a row for each node, the root included: the smallest member, its parent's one, and counts over members, children
and the whole subtree.

1. Turns are numbered within their conversation by ranges of rows (`ranks`), and so are prefixes: a prefix's 128-bit name is the
   exclusive or of its turns' hashes, each taken with its depth. So no task has to hold a conversation.
2. A prefix that one conversation has is a node of a chain, known without a trie: it has one member and no
   savings. Only prefixes of two or more are merged, so a conversation enters the sort with the turns that it shares.
3. Runs: each batch of conversations is sorted by its turns, and every conversation carries the number of turns that it shares
   with the one before it. The runs are written to the shared folder.
4. Runs are dealt to ranges of (turns, conversation), so copies of one conversation are dealt to as many ranges as they need.
   In a range a loser tree merges what each run has there. Of two heads, the one that shares more with the last one given out is
   the smaller; turns are only compared, from there on, if both share as much. So no shared turn is read again.
5. The merged stream goes over a stack of open nodes. A conversation closes the nodes below what it shares with the one before
   it; a closed node is finished, and adds its counts to its parent.
6. Nodes on the path of a range's first or last conversation may go on in other ranges. They are given out as they stand, and
   the same stack merges those of sixteen ranges, until one is left. There are as many as the paths are long.
7. The members that end in a node are sorted by ranges too, and joined to texts of some hundred kilobytes; the hash of a node reads these.

`rebuilt` makes the conversations of the query: the first h turns of the conversation of the same hundred, then its own after its
first h. `prefix_trie` takes any numbered turns.

Nulls and odd input: a null role or text is empty. A null turn comes first; turns of one number come in the order of a hash of role
and text, so rows that repeat are turns of their own. Rows without a conv_id are left out, as no conversation has them. A
conversation that has no turns left ends in the root. An empty table gives no row, not even a root. Very long texts are hashed
by Spark. The memory of a task follows its range of the sort and the turns that one conversation shares with another.
Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm.common import stored, table
from presswork.llm.ranks import in_ranges, running

#: Ranges whose open nodes meet in a task.
FAN = 16
#: Rows that a task gives out at once; bytes of a text of ids.
ROWS, BYTES = 1 << 14, 1 << 17
FINAL, FIRST, LAST = 0, 1, 2
NODE = "id1 long, id2 long, up1 long, up2 long, depth long, chars long, conv long, n long, children long, leaves long, saved long, state long, part long"
NAMES = [x.split()[0] for x in NODE.split(", ")]

Turn = tuple[int, int]


# Turns, numbers and names of prefixes.


def _named(one: Column, two: Column, depth: Column) -> list[Column]:
    """A turn's two hashes at its depth."""
    return [F.xxhash64(one, depth).alias("q1"), F.xxhash64(two, depth, F.lit(1)).alias("q2")]


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(c, at, h1, h2, chars, and the marks of the ranges) of turns (conv_id, turn, role, text), `at` from 1."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), "turn", F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(7), text, role).alias("h2"), F.length(text).cast("long").alias("chars"))
    order = ["turn", "h1", "h2"]
    return stored(running(in_ranges(hashed, ["c"], order), ["c"], order, at=("sum", F.lit(1).cast("long"))))


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (c, depth, chars, q1, q2, p1, p2) of their turns, and (c, length)."""
    placed = numbered_turns(turns).withColumn("depth", F.col("at"))
    rows = running(placed.select("*", *_named(F.col("h1"), F.col("h2"), F.col("depth"))), ["c"], ["depth"], p1=("bit_xor", F.col("q1")), p2=("bit_xor", F.col("q2")))
    return stored(rows.select("c", "depth", "chars", "q1", "q2", "p1", "p2")), stored(placed.groupBy("c").agg(F.max("at").alias("length")))


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Like `plain`, of conversations that begin with the first turns of the first conversation of their hundred."""
    placed = numbered_turns(turns)
    sizes = placed.groupBy("c").agg(F.max("at").alias("own"))
    heads = placed.where((F.col("c") % every == 0) & (F.col("at") < most)).select(F.col("c").alias("base"), F.col("at").alias("depth"), "chars", *_named(F.col("h1"), F.col("h2"), F.col("at")))
    whole = Window.partitionBy("base").orderBy("depth")  # fewer than `most` rows each
    heads = stored(heads.select("*", F.bit_xor("q1").over(whole).alias("p1"), F.bit_xor("q2").over(whole).alias("p2")))
    bases = heads.groupBy("base").agg(F.max("depth").alias("there"))
    h = (F.crc32(F.col("c").cast("string")) % most).cast("long")
    cut = sizes.select("c", "own", h.alias("h"), (F.col("c") - F.col("c") % every).alias("base")).join(bases, "base", "left")
    cut = cut.withColumn("head", F.least("h", F.coalesce("there", F.lit(0))))
    names = heads.select("base", F.col("depth").alias("head"), F.col("p1").alias("b1"), F.col("p2").alias("b2"))
    convs = stored(cut.join(names, ["base", "head"], "left").select("c", "h", "base", "head", F.coalesce("b1", F.lit(0)).alias("b1"), F.coalesce("b2", F.lit(0)).alias("b2"), (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")))
    own = placed.join(convs.select("c", "h", "head", "b1", "b2"), "c").where("at > h").withColumn("depth", F.col("head") + F.col("at") - F.col("h"))
    own = running(own.select("*", *_named(F.col("h1"), F.col("h2"), F.col("depth"))), ["c"], ["depth"], x1=("bit_xor", F.col("q1")), x2=("bit_xor", F.col("q2")))
    own = own.select("c", "depth", "chars", "q1", "q2", F.col("b1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("b2").bitwiseXOR(F.col("x2")).alias("p2"))
    taken = convs.select("c", "base", "head").join(heads, "base").where("depth <= head").select("c", "depth", "chars", "q1", "q2", "p1", "p2")
    return stored(own.unionByName(taken)), convs.select("c", "length")


# Runs, their merge, and the stack.


def shared_turns(one: list[Turn], two: list[Turn], known: int = 0) -> int:
    """How many turns both begin with, if they agree in the first `known`."""
    end = min(len(one), len(two))
    while known < end and one[known] == two[known]:
        known += 1
    return known


class Run:
    """Sorted conversations, each with the turns that it shares with the one before."""

    def __init__(self, paths: list[list[Turn]], shared: list[int], rows: list[tuple]):
        self.paths, self.shared, self.rows, self.at = paths, shared, rows, 0


class LoserTree:
    """Merges runs. An inner node holds the run that lost there, and `known` what a run's head shares with the head that beat it."""

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self.known = [0] * len(runs)
        self.size = max(len(runs), 1)
        self.lost = [-1] * self.size
        self.compared = 0
        winners = [-1] * self.size + list(range(len(runs))) + [-1] * (self.size - len(runs))
        for node in range(self.size - 1, 0, -1):
            winners[node], self.lost[node] = self._play(winners[2 * node], winners[2 * node + 1])
        self.best = winners[1] if self.size > 1 else (0 if runs else -1)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs, -1 being none."""
        if a < 0 or b < 0:
            return (b, a) if a < 0 else (a, b)
        one, two = self.runs[a], self.runs[b]
        if one.at == len(one.paths) or two.at == len(two.paths):
            return (b, a) if one.at == len(one.paths) else (a, b)
        if self.known[a] != self.known[b]:
            return (a, b) if self.known[a] > self.known[b] else (b, a)
        first, second = one.paths[one.at], two.paths[two.at]
        both = shared_turns(first, second, self.known[a])
        self.compared += both - self.known[a] + 1
        less = (first[both:], one.rows[one.at]) < (second[both:], two.rows[two.at]) if both == min(len(first), len(second)) else first[both] < second[both]
        winner, loser = (a, b) if less else (b, a)
        self.known[loser] = both
        return winner, loser

    def __iter__(self) -> Iterator[tuple[list[Turn], int, tuple]]:
        """(turns, how many are shared with the one before, row) in order."""
        while self.best >= 0 and (run := self.runs[self.best]).at < len(run.paths):
            k = self.best
            yield run.paths[run.at], self.known[k], run.rows[run.at]
            run.at += 1
            self.known[k] = run.shared[run.at] if run.at < len(run.paths) else 0
            node, winner = (k + self.size) // 2, k
            while node:
                winner, self.lost[node] = self._play(winner, self.lost[node])
                node //= 2
            self.best = winner


class Node:
    __slots__ = ("id", "up", "depth", "chars", "conv", "n", "children", "leaves", "saved", "first")

    def __init__(self, id_: Turn, up: Turn | None, depth: int, chars: int, first: bool):
        self.id, self.up, self.depth, self.chars, self.first = id_, up, depth, chars, first
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0

    def add(self, conv: int | None, n: int, children: int, leaves: int, saved: int) -> None:
        if conv is not None:
            self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved


class Stack:
    """The open nodes from the root down. `out` takes rows of finished ones and, unless `whole`, of those that other ranges may have."""

    def __init__(self, whole: bool, part: int = 0):
        self.open: list[Node] = []
        self.out: list[tuple] = []
        self.whole, self.part, self.closed = whole, part, False

    def push(self, id_: Turn, chars: int) -> Node:
        above = self.open[-1] if self.open else None
        self.open.append(Node(id_, above.id if above else None, len(self.open), chars, not self.closed))
        return self.open[-1]

    def close(self, depth: int) -> None:
        """Closes all nodes of more than `depth` turns."""
        while len(self.open) > depth + 1:
            self.closed = True
            node = self.open.pop()
            if node.first and not self.whole:
                self._give(node, FIRST)
                continue
            node.saved += (node.n - 1) * node.chars
            node.leaves = node.leaves if node.children else 1
            self._give(node, FINAL)
            if self.open:
                self.open[-1].add(node.conv, node.n, 1, node.leaves, node.saved)

    def end(self) -> None:
        if self.whole:
            self.close(-1)
        for node in reversed(self.open):
            self._give(node, FIRST if node.first else LAST)
        self.open = []

    def _give(self, x: Node, state: int) -> None:
        self.out.append((*x.id, *(x.up or (None, None)), x.depth, x.chars, x.conv, x.n, x.children, x.leaves, x.saved, state, self.part))

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.out) >= least:
            columns = list(zip(*self.out, strict=True))
            self.out = []
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)


def walk(merged: Iterable[tuple[list[Turn], int, tuple]], part: int) -> Iterator[pa.RecordBatch]:
    """Nodes of conversations (turns, shared, (c, goes on, characters of each turn)) in order."""
    stack = Stack(False, part)
    for turns, shared, (c, on, chars) in merged:
        if not stack.open:
            stack.push((0, 0), 0)
        stack.close(shared)
        for i in range(shared, len(turns)):
            x, y = stack.open[-1].id
            stack.push((x ^ turns[i][0], y ^ turns[i][1]), chars[i])
        stack.open[-1].add(c, 1, on, on, 0)
        yield from stack.batches(ROWS)
    stack.end()
    yield from stack.batches()


def _paths(batch: pa.RecordBatch, column: int) -> tuple[list[list[Turn]], list[list[int]]]:
    lists = batch.column(column)
    at = np.asarray(lists.offsets).tolist()
    one, two, chars = (lists.values.field(i).to_pylist() for i in (1, 2, 3))
    turns = list(zip(one, two, strict=True))
    return [turns[a:b] for a, b in zip(at, at[1:], strict=False)], [chars[a:b] for a, b in zip(at, at[1:], strict=False)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, no, shared, c, goes_on, path): each batch of (c, goes_on, path) as a sorted run."""
    for number, batch in enumerate(batches):
        paths, _ = _paths(batch, 2)
        c = batch.column(0).to_pylist()
        order = sorted(range(batch.num_rows), key=lambda i: (paths[i], c[i]))
        shared = [0] + [shared_turns(paths[a], paths[b]) for a, b in zip(order, order[1:], strict=False)]
        run = TaskContext.get().partitionId() << 32 | number
        yield pa.RecordBatch.from_arrays([pa.array([run] * len(order), pa.int64()), pa.array(range(len(order)), pa.int64()), pa.array(shared[: len(order)], pa.int64()), *(batch.column(i).take(pa.array(order, pa.int64())) for i in range(3))], names=["run", "no", "shared", "c", "goes_on", "path"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a range of runs (run, no, shared, c, goes_on, path), which come by run and number."""
    runs: list[Run] = []
    last = None
    for batch in batches:
        paths, chars = _paths(batch, 5)
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for run, no, shared, c, on, path, lengths in zip(*columns, paths, chars, strict=True):
            if last is None or last[0] != run:
                runs.append(Run([], [], []))
            # What lies between two of a run is in another range only if they are not neighbours there.
            known = shared if last == (run, no - 1) else shared_turns(runs[-1].paths[-1], path) if runs[-1].paths else 0
            runs[-1].paths.append(path)
            runs[-1].shared.append(known)
            runs[-1].rows.append((c, on, lengths))
            last = (run, no)
    yield from walk(LoserTree(runs), TaskContext.get().partitionId())


def _joined(whole: bool):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("state", "ascending"), ("depth", "ascending")])
        stack = Stack(whole, rows["part"][0].as_py() // FAN if rows.num_rows else 0)
        for one, two, _, _, depth, chars, conv, n, children, leaves, saved, *_ in zip(*(rows[c].to_pylist() for c in NAMES), strict=True):
            if len(stack.open) <= depth or stack.open[depth].id != (one, two):
                stack.close(depth - 1)
                stack.push((one, two), chars)
            stack.open[depth].add(conv, n, children, leaves, saved)
        stack.end()
        columns = list(zip(*stack.out, strict=True)) or [()] * len(NAMES)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(e1, e2, first, ids): of sorted (e1, e2, c), the ids of each node as texts of about BYTES."""
    node, first, ids, size = None, 0, [], 0
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["e1", "e2", "first", "ids"])

    for rows in batches:
        for one, two, c in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
            if ids and (node != (one, two) or size >= BYTES):
                out.append((*node, first, ",".join(ids)))
                ids, size = [], 0
                if len(out) >= 1024 or len(out[-1][3]) >= BYTES:
                    yield batch()
                    out.clear()
            if not ids:
                node, first = (one, two), c
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        out.append((*node, first, ",".join(ids)))
    if out:
        yield batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(e1, e2, ends): the hash of each node's ids, of texts (e1, e2, first, ids) in order."""
    node, state = None, None
    for rows in batches:
        out = []
        for one, two, _, ids in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
            if node == (one, two):
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                out.append((*node, state.hexdigest()))
            node, state = (one, two), hashlib.sha256(ids.encode())
        if out:
            yield _ends(out)
    if node is not None:
        yield _ends([(*node, state.hexdigest())])


def _ends(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["e1", "e2", "ends"])


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes, of (c, depth, chars, q1, q2, p1, p2) of turns and (c, length) of all conversations."""
    # Written, so that a common prefix's rows can be dealt to several tasks when they meet it.
    several = stored(rows.groupBy("p1", "p2").agg(F.count("*").alias("n")).where("n > 1").select("p1", "p2"))
    common = rows.join(several, ["p1", "p2"], "left_semi")
    path = F.sort_array(F.collect_list(F.struct("depth", "q1", "q2", "chars"))).alias("path")
    shared = common.groupBy("c").agg(F.max("depth").alias("s"), F.max_by(F.struct("p1", "p2"), "depth").alias("end"), path)
    none = F.array().cast("array<struct<depth:bigint,q1:bigint,q2:bigint,chars:bigint>>")
    items = stored(convs.join(shared, "c", "left").select("c", "length", F.coalesce("s", F.lit(0)).cast("long").alias("s"), F.coalesce("end.p1", F.lit(0)).alias("e1"), F.coalesce("end.p2", F.lit(0)).alias("e2"), F.coalesce("path", none).alias("path")))
    goes_on = (F.col("length") > F.col("s")).cast("long").alias("goes_on")
    runs = stored(items.select("c", goes_on, "path").mapInArrow(_runs, f"run long, no long, shared long, c long, goes_on long, path {items.schema['path'].dataType.simpleString()}"))
    # The turns alone tell the order; depths are the same at the same place.
    ranged = runs.withColumn("order", F.transform("path", lambda x: F.struct(x["q1"], x["q2"]))).repartitionByRange("order", "c").sortWithinPartitions("run", "no").drop("order")
    made = stored(ranged.mapInArrow(_merged, NODE))
    finished = made.where(F.col("state") == FINAL)
    while True:
        parts = made.agg(F.max("part")).first()[0] or 0
        unfinished = made.where(F.col("state") != FINAL)
        whole = parts < FAN
        made = stored(unfinished.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(_joined(whole), NODE))
        finished = finished.unionByName(made.where(F.col("state") == FINAL))
        if whole:
            break

    ends = items.where("length = s").select("e1", "e2", "c").repartitionByRange("e1", "e2", "c").sortWithinPartitions("e1", "e2", "c")
    texts = stored(ends.mapInArrow(_texts, "e1 long, e2 long, first long, ids string"))
    hashes = texts.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "first").mapInArrow(_hashed, "e1 long, e2 long, ends string")
    nobody = F.sha2(F.lit(""), 256)
    nodes = finished.join(hashes, (F.col("id1") == F.col("e1")) & (F.col("id2") == F.col("e2")), "left")
    nodes = stored(nodes.select("id1", "id2", "up1", "up2", "depth", "conv", "n", "children", "leaves", "saved", F.coalesce("ends", nobody).alias("ends")))

    alone = rows.join(items.select("c", "s", "length"), "c").where("depth > s")
    one = F.lit(1).cast("long")
    last = F.col("depth") == F.col("length")
    chain = alone.select(
        F.col("p1").bitwiseXOR(F.col("q1")).alias("up1"), F.col("p2").bitwiseXOR(F.col("q2")).alias("up2"), "depth", F.col("c").alias("conv"), one.alias("n"), F.when(last, 0).otherwise(1).cast("long").alias("children"), one.alias("leaves"),
        F.lit(0).cast("long").alias("saved"), F.when(last, F.sha2(F.col("c").cast("string"), 256)).otherwise(nobody).alias("ends"), (F.col("depth") == F.col("s") + 1).alias("begins"),
    )
    columns = ["depth", "conv", "n", "children", "leaves", "saved", "ends"]
    hanging = nodes.select("up1", "up2", *columns).unionByName(chain.where("begins").select("up1", "up2", *columns))
    parents = nodes.select(F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("conv").alias("parent"))
    placed = hanging.join(parents, ["up1", "up2"], "left").select(*columns, "parent")
    every = placed.unionByName(chain.where(~F.col("begins")).select(*columns, F.col("conv").alias("parent")))
    return every.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def op11_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))
