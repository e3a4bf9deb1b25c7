"""Operator 11 against a plain trie in Python, the merge by itself, and ranges."""

import collections
import hashlib
import random
import zlib

from pyspark.sql import functions as F

from presswork.llm import op11_trie as op11
from presswork.llm.queries import QUERIES
from presswork.llm.ranks import in_ranges, numbered, running

SCHEMA = "conv_id long, turn long, role string, text string, c string, depth string, q1 int, n int"


def turns_of(rows, spark):
    """Turns of each conversation in order; those of one number by Spark's hash of role and text."""
    hashed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, conv_id long, turn long, role string, text string")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = {r.i: r.h for r in hashed.select("i", F.xxhash64(role, text).alias("h")).collect()}
    out = collections.defaultdict(list)
    for i, (c, turn, role, text) in enumerate(rows):
        if c is not None:
            out[c].append(((turn is not None, turn or 0, order[i]), (role or "", text or "")))
    return {c: [x for _, x in sorted(own, key=lambda y: y[0])] for c, own in out.items()}


def plain_trie(convs):
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        str((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())) for p, own in members.items()
    )


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def conversations():
    rng = random.Random(4)
    rows = []
    for c in [*range(150), *range(200, 260), 1000, 10**12, 10**12 + 7]:
        for t in range(rng.choice([1, 2, 3, 4, 7])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ho é", "", None, "x" * 30])))
    rows += [(300 + i, t, "user", f"same {t}") for i in range(40) for t in range(3)]
    rows += [(5, None, "system", "first of all"), (6, 0, "user", "again"), (6, 0, "user", "again"), (6, 0, "tool", "b"), (None, 1, "user", "nobody's"), (7, 2, None, None)]
    rows += [(500 + i, t, "user", f"t{t}" if t < 40 else f"{i}-{t}") for i in range(2) for t in range(60)]
    return rows


def write(spark, path, rows):
    spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], SCHEMA).repartition(5).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_query(spark, tmp_path):
    rows = conversations()
    got = QUERIES["op11_trie"](spark, write(spark, tmp_path, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_trie(rebuilt(turns_of(rows, spark)))


def test_as_they_are(spark, monkeypatch):
    """Plain conversations, over many ranges and with a fan of two, so that open nodes are merged several times."""
    monkeypatch.setattr(op11, "FAN", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = conversations()
        turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
        got = op11.prefix_trie(*op11.plain(turns))
        assert sorted(str(tuple(r)) for r in got.collect()) == plain_trie(turns_of(rows, spark))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_turns_and_one(spark, tmp_path):
    assert QUERIES["op11_trie"](spark, write(spark, tmp_path / "none", [])).collect() == []
    rows = [(3, 1, "user", "x")]
    got = QUERIES["op11_trie"](spark, write(spark, tmp_path / "one", rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_trie(rebuilt({3: [("user", "x")]}))


def run_of(items):
    items = sorted(items)
    paths = [p for p, _ in items]
    return op11.Run(paths, [0] + [op11.shared_turns(a, b) for a, b in zip(paths, paths[1:], strict=False)], [(c, 0, []) for _, c in items])


def test_loser_tree():
    rng = random.Random(5)
    for k in [0, 1, 2, 3, 5, 8, 13]:
        items = [([(rng.randrange(2), 0) for _ in range(rng.randrange(8))], c) for c in range(k * 20)]
        tree = op11.LoserTree([run_of(items[i::k]) for i in range(k)])
        got = list(tree)
        assert [(p, r[0]) for p, _, r in got] == sorted(items)
        assert [s for _, s, _ in got][1:] == [op11.shared_turns(a, b) for (a, _), (b, _) in zip(sorted(items), sorted(items)[1:], strict=False)]


def test_shared_turns_are_not_compared_again():
    """Of conversations that share 500 turns, the merge reads about one turn each time."""
    head = [(7, i) for i in range(500)]
    tree = op11.LoserTree([run_of([([*head, (c, 0)], c) for c in range(i, 800, 8)]) for i in range(8)])
    assert len(list(tree)) == 800 and tree.compared < 7 * 501 + 800 * 4


def test_texts_of_ids():
    rows = [(1, 1, c) for c in range(60_000)] + [(1, 2, 5), (2, 0, 1), (2, 0, 9)]
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + 7000], strict=True)], names=["e1", "e2", "c"]) for i in range(0, len(rows), 7000)]
    texts = list(op11._texts(iter(batches)))
    assert sum(b.num_rows for b in texts) > 3
    got = {tuple(r[:2]): r[2] for b in op11._hashed(iter(texts)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(1, 1): sha(range(60_000)), (1, 2): sha([5]), (2, 0): sha([1, 9])}


def test_ranges(spark):
    """Places and totals of a group with most rows, of equal rows, and of null groups."""
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, 1, 2, 3, 4, 5])) for _ in range(3000)] + [("same", 1)] * 1000
    df = spark.createDataFrame(rows, "g string, v long").repartition(6)
    got = collections.defaultdict(list)
    for r in numbered(df, ["g"], ["v"]).collect():
        got[r.g].append((r.place, r.v))
    for g, own in got.items():
        assert [p for p, _ in sorted(own)] == list(range(len(own)))
        assert [v for _, v in sorted(own)] == sorted((v for x, v in rows if x == g), key=lambda v: (v is not None, v or 0))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ranged = in_ranges(df, ["g"], ["v"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranged.where("g = 'hot'").select("_range").distinct().count() > 1
    ends = running(ranged, ["g"], ["v"], x=("bit_xor", F.col("_row")), n=("sum", F.lit(1).cast("long"))).groupBy("g").agg(F.max_by("x", "n").alias("x"))
    want = {r.g: r.x for r in ranged.groupBy("g").agg(F.bit_xor("_row").alias("x")).collect()}
    assert {r.g: r.x for r in ends.collect()} == want
