"""Kept feeds equal feeds made anew, after batches and removals."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from presswork.operators import feeds
from presswork.streaming.kept import KeptFeeds

SCHEMA = "site string, hash string, published_at timestamp, first_seen timestamp, title string"


def files(root):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


def test_kept_feeds(spark, tmp_path):
    rng, t = random.Random(5), datetime(2024, 1, 1)
    kept, every = KeptFeeds(spark, str(tmp_path / "feeds"), ["site"], SCHEMA, 4), []
    whole = lambda: sorted(map(tuple, feeds.top_items_per(spark.createDataFrame(every, SCHEMA), ["site"], 4).drop("rank").collect()))
    now = lambda: sorted(map(tuple, kept.read().collect()))
    for turn in range(4):
        batch = []
        for i in range(40):
            published = None if rng.random() < 0.2 else t + timedelta(hours=rng.randrange(200))
            batch.append((rng.choice("aabcdefg"), f"{turn}-{i:02}", published, t + timedelta(hours=turn), "x"))
        every += batch
        kept.add(spark.createDataFrame(batch + batch[:5], SCHEMA))
        assert now() == whole(), turn
    # Nothing better, nothing written.
    before = files(tmp_path / "feeds")
    old = [("a", "old", t - timedelta(days=900), t - timedelta(days=900), "x")]
    assert kept.add(spark.createDataFrame(old, SCHEMA)) == 0 and kept.add(spark.createDataFrame(every, SCHEMA)) == 0 and files(tmp_path / "feeds") == before
    every += old
    # One feed changes: the other buckets' files stay.
    assert kept.add(spark.createDataFrame([("b", "new", t + timedelta(days=90), t, "x")], SCHEMA)) == 1
    every.append(("b", "new", t + timedelta(days=90), t, "x"))
    after = files(tmp_path / "feeds")
    assert now() == whole() and len({os.path.dirname(f) for f in set(before) - set(after)}) == 1
    # What is taken away is filled up; the last feed of a site goes.
    gone = [r for r in every if r[0] == "c" or r[1] == "new"]
    every = [r for r in every if r not in gone]
    assert kept.remove(spark.createDataFrame(gone, SCHEMA), spark.createDataFrame(every, SCHEMA)) == 2
    assert now() == whole() and kept.read().where(F.col("site") == "c").isEmpty()
