"""Sites' state over time: run starts and new profiles, from tables and from streams, against plain loops."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from presswork.functions import dates
from presswork.operators import profile
from presswork.streaming import schedule
from presswork.streaming.ingest import REPROFILED, Store, bucket_of

SINCE = datetime(2024, 1, 1)
SCHEMA = "site string, schedule string, since timestamp, no long, seconds long"


def plain_starts(site, expression, seconds, spread):
    """All ticks one by one."""
    expression = expression if expression and dates.is_cron(expression) else schedule.DEFAULT_SCHEDULE
    tick = schedule.next_tick(site, expression, SINCE, spread)
    out, busy, dropped = [], None, 0
    while True:
        if busy is None or tick >= busy:
            out.append((site, len(out) + 1, tick, dropped))
            dropped = 0
            if len(out) > len(seconds):
                return out
            busy = tick + timedelta(seconds=seconds[len(out) - 1])
        else:
            dropped += 1
        tick = schedule.next_tick(site, expression, tick, spread)


def reports():
    rng = random.Random(7)
    rows, want = [], []
    for site, expression in [("a", "*/20 * * * *"), ("b", "0 3 * * 1"), ("c", "junk"), ("d", None), ("e", "5,35 * * * *")]:
        seconds = [rng.randrange(9000) for _ in range(rng.randrange(4, 12))]
        rows += [(site, expression, SINCE, i + 1, s) for i, s in enumerate(seconds)]
        want += plain_starts(site, expression, seconds, 300)
    rows += [("new", "0 0 * * *", SINCE, None, None), (None, "0 0 * * *", SINCE, 1, 5)]
    want += plain_starts("new", "0 0 * * *", [], 300)
    return rows, sorted(want)


def test_run_starts_of_a_table(spark):
    schedule.with_state_store(spark)
    rows, want = reports()
    random.Random(1).shuffle(rows)
    assert sorted(map(tuple, schedule.run_starts(spark.createDataFrame(rows, SCHEMA), 300).collect())) == want
    assert schedule.run_starts(spark.createDataFrame([], SCHEMA)).collect() == []


def streamed(spark, tmp_path, rows, schema, of, parts):
    """The result of `of` over rows that come in several batches."""
    schedule.with_state_store(spark)
    for i in range(parts):
        spark.createDataFrame(rows[len(rows) * i // parts : len(rows) * (i + 1) // parts], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for name in os.listdir(tmp_path / "in"):
            os.utime(tmp_path / "in" / name, (1e9 + i, 1e9 + i)) if name.endswith(".parquet") and os.path.getmtime(tmp_path / "in" / name) > 1.5e9 else None
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    # With timers by the clock, batches without rows would go on for ever.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    query = of(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))


def test_run_starts_of_a_stream(spark, tmp_path):
    """Reports that come before their run's turn wait in the state."""
    rows, want = reports()
    random.Random(2).shuffle(rows)
    assert streamed(spark, tmp_path, rows, SCHEMA, lambda df: schedule.run_starts(df, 300), 3) == want


class Asked:
    """A state store that counts its messages."""

    def __init__(self):
        self.n = 0

    def __getattr__(self, name):
        def ask(*_):
            self.n += 1
            return False if name in ("exists", "containsKey") else []

        return (lambda *_: self) if name in ("getValueState", "getMapState") else ask

    def getCurrentProcessingTimeInMs(self):
        return schedule._ms(SINCE + timedelta(days=30))


def test_messages_of_a_new_site():
    """Reports in order ask the store nothing, however many they are."""
    rows = [Row(schedule="*/30 * * * *", since=SINCE, no=n + 1, seconds=2000) for n in range(200)]
    for some in (rows[:1], rows):
        ticks, store = schedule.Ticks(600), Asked()
        ticks.init(store)
        out = list(ticks.handleInputRows(("a",), iter(some), store))
        assert [r.at for r in out] == [w[2] for w in plain_starts("a", "*/30 * * * *", [2000] * len(some), 600)] and store.n == 2


def test_next_run_against_every_minute():
    rng = random.Random(2)
    for expression in ["*/30 * * * *", "7,50 3-9/2 * * *", "0 0 29 2 *", "15 23 1 * 1", "* * * * *", "59 23 31 12 *", "5 4 * * 7"]:
        ok = [dates.cron_field(f, *r) for f, r in zip(expression.split(), [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)], strict=True)]
        for _ in range(3):
            at = after = datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(59 * 86400))
            at = at.replace(second=0) + timedelta(minutes=1)
            while True:
                day, week = ok[2](at.day), ok[4](at.isoweekday() % 7) or (at.isoweekday() == 7 and ok[4](7))
                both = (day or week) if expression.split()[2] != "*" and expression.split()[4] != "*" else (day and week)
                if ok[0](at.minute) and ok[1](at.hour) and ok[3](at.month) and both:
                    break
                at += timedelta(minutes=1)
            assert dates.next_run(expression, after) == at


def test_jitter_is_spread():
    moments = [schedule.jitter(s, SINCE, 600) for s in range(2000)]
    assert min(moments) < 10 and max(moments) > 590 and abs(sum(moments) / 2000 - 300) < 20
    assert schedule.jitter("x", SINCE, 0) == 0


def weak_runs():
    rng = random.Random(3)
    rows = sorted((SINCE + timedelta(minutes=rng.randrange(5000)), rng.choice("abc"), rng.random() < 0.7) for _ in range(300))
    rows = [(s, t, w) for t, s, w in rows]
    want = []
    for site in "abc":
        last = None
        for s, t, w in rows:
            if s == site and w and (last is None or t - last > timedelta(hours=6)):
                want.append((s, t))
                last = t
    return rows, sorted(want)


def test_reprofile_times(spark, tmp_path):
    schedule.with_state_store(spark)
    rows, want = weak_runs()
    schema = "site string, at timestamp, weak boolean"
    assert sorted(map(tuple, schedule.reprofile_times(spark.createDataFrame([*rows, (None, SINCE, True), ("a", None, True), ("a", SINCE, None)], schema)).collect())) == want
    assert streamed(spark, tmp_path, rows, schema, schedule.reprofile_times, 4) == want


INDEX = "<html><body>" + "".join(f'<a href="/2024/05/0{i}/a-long-story-number-{i}">A headline with words enough about {i}</a>' for i in range(1, 9)) + "</body></html>"


def test_store_profiles_anew(spark, tmp_path):
    """A weak site's settings are written with what its index shows; other sites and other settings stay."""
    store = Store(spark, str(tmp_path))
    for site in ("a.example", "b.example", "c.example"):
        store.add_site(site, f"https://{site}/", '{"title":"T","extract":{"mode":"embedded-json","max":50},"own":1}')
        store.add_section(site, "news", f"https://{site}/news")
    store.put("a.example", REPROFILED, "2024-01-02 00:00:00")
    store.put("c.example", REPROFILED, "2023-01-02 00:00:00")
    pages = spark.createDataFrame([(1, "https://a.example/news/", INDEX), (2, "https://b.example/news", INDEX)], "page_id long, url string, html string")
    done = store.reprofile(pages, F.lit("2024-01-01").cast("timestamp")).collect()
    assert [(r.site, r.mode, r.candidates, r.changed) for r in done] == [("a.example", "anchors", 8, True)]
    configs = {r.site: r.config_json for r in store.sites().collect()}
    assert configs["b.example"] == configs["c.example"] == '{"title":"T","extract":{"mode":"embedded-json","max":50},"own":1}'
    assert spark.createDataFrame([(configs["a.example"],)], "c string").select(F.get_json_object("c", "$.extract.mode"), F.get_json_object("c", "$.extract.max"), F.get_json_object("c", "$.own"), F.get_json_object("c", "$.template")).first() == ("anchors", "50", "1", "generic")
    assert not store.reprofile(pages, F.lit("2024-01-01").cast("timestamp")).first().changed


def test_profile_of_settings_that_cannot_be_read(spark):
    sites = spark.createDataFrame([("a", "{bad"), ("b", None), ("c", '{"extract":{"max":"x\\"y","follow":true}}')], "site string, config_json string")
    found = spark.createDataFrame([("a", "anchors", 3), ("b", None, None), ("c", "auto", 0)], "site string, mode string, candidates long")
    got = {r.site: r.config_json for r in profile.reprofiled(sites, found).collect()}
    assert got["a"] == '{"template":"generic","extract":{"hint":"auto-detected: anchors (3 candidates)","mode":"anchors"}}'
    assert got["b"] == got["c"] == '{"template":"generic","extract":{"hint":"auto-detected: auto (0 candidates)","mode":"auto"}}'


def files_of(path):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.range(400).select(F.concat(F.lit("s"), (F.col("id") % 40).cast("string")).alias("site"), F.sha1(F.col("id").cast("string")).alias("hash"), F.col("id").cast("string").alias("url"))
    store.append("items", rows)
    store.append("item_sections", rows.select("site", "hash", F.lit("x").alias("section")))
    bucket = store.bucket("s3")
    before = files_of(tmp_path / "items")
    store.remove("s3")
    after = files_of(tmp_path / "items")
    own = lambda files: {k: v for k, v in files.items() if f"bucket={bucket}/" not in k}
    assert own(before) == own(after) and before != after
    assert store.read("items").count() == 390 and store.read("items").where("site = 's3'").isEmpty()
    alone = next(s for s in (f"only{i}" for i in range(500)) if store.bucket(s) not in {r.b for r in store.read("items").select(bucket_of(F.col("site")).alias("b")).distinct().collect()})
    store.append("items", rows.limit(3).withColumn("site", F.lit(alone)))
    store.remove(alone)
    assert store.read("items").count() == 390 and not os.path.exists(tmp_path / "items" / f"bucket={store.bucket(alone)}")


def test_small_files_are_put_together(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    row = spark.createDataFrame([("a", "k", "v")], "site string, key string, value string").withColumn("at", F.current_timestamp())
    for _ in range(4):
        store.append("kv", row)
    store.append("kv", row.withColumn("site", F.lit("b")))
    assert store.compact("kv", 3) == [store.bucket("a")] and store.compact("kv", 3) == [] and store.read("kv").count() == 5
    assert len(files_of(tmp_path / "kv")) == 2


def test_settings_of_a_site(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.add_site("a", "https://a.example/")
    store.add_site("b", "https://b.example/")
    assert store.update_site("a", schedule="0 * * * *", title="A", private=True) and not store.update_site("none", title="x")
    assert store.set_config("a", scrape_delay={"lower_sec": 1, "upper_sec": 2}, ignore_images=True) and store.set_config("a", ignore_images=None)
    got = {r.site: (r.url, r.schedule, r.title, r.private, r.config_json) for r in store.read("sites").collect()}
    assert got == {"a": ("https://a.example/", "0 * * * *", "A", True, '{"scrape_delay": {"lower_sec": 1, "upper_sec": 2}}'), "b": ("https://b.example/", None, None, None, None)}
