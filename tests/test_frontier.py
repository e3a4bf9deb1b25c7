"""The frontier: all of a link table, to the full depth."""

import random

import pytest

from presswork import session
from presswork.operators import discover
from presswork.plans import web


def brute(pairs, seed, depth=8, most=40):
    links = {}
    for a, b in pairs:
        links.setdefault(a, set()).add(b)
    level = {seed: 0}
    now = [seed]
    for n in range(1, depth + 1):
        now = sorted({b for a in now for b in links.get(a, ())} - set(level))
        level |= dict.fromkeys(now, n)
    return sorted(level.items(), key=lambda x: (x[1], x[0]))[:most]


def test_links_of_any_key_count_to_depth_8(spark, tmp_path):
    # A chain of orders and parts, all with keys from 1000 on, of more than eight levels.
    lines = [x for i in range(12) for x in ((5000 + i, 2000 + i), (5000 + i, 2001 + i))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = web.bfs_frontier_links(spark, str(tmp_path)).collect()
    pairs = [p for o, q in lines for p in ((2 * o, 2 * q + 1), (2 * q + 1, 2 * o))]
    assert sorted(((r.url, r.level) for r in got), key=lambda x: (x[1], x[0])) == brute(pairs, 10000)
    assert max(r.level for r in got) == 8


def test_frontier_of_sites(spark):
    rng = random.Random(1)
    pairs = {s: [(rng.randrange(60), rng.randrange(60)) for _ in range(80)] for s in ("a", "b")}
    edges = spark.createDataFrame([(s, *p) for s, ps in pairs.items() for p in ps], "site string, src long, dst long")
    seeds = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "site string, url long")
    got = sorted((r.site, r.level, r.url) for r in discover.frontier(edges, seeds, most=15).collect())
    want = [("a", n, u) for u, n in brute(pairs["a"], 1, most=15)] + [("b", n, u) for u, n in brute(pairs["b"], 2, most=15)] + [("c", 0, 3)]
    assert got == sorted(want)


@pytest.mark.parametrize("make", [web.bfs_frontier, web.bfs_frontier_links], ids=lambda f: f.__name__)
def test_edges_are_held_in_no_task(spark, monkeypatch, make):
    """Edges are written without a shuffle or a table of them in memory; repeats only go from what a level reaches."""
    plans = []
    monkeypatch.setattr(discover, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or session.stored(df))
    assert len(make(spark, "/root/testdata/sf0.001").collect()) == 40
    assert "Aggregate" not in plans[0] and "Join" not in plans[0]
