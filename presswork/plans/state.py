"""Queries that keep state for each site, with recursive SQL for the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from presswork.functions import urls
from presswork.operators import discover, profile
from presswork.plans.derived import _MERGED, ORIGIN, sightings
from presswork.plans.registry import query, table
from presswork.plans.web import pages
from presswork.streaming import schedule

SPREAD = 600
_BASE = "(1704067200 + 1800 * ({n} + 1))"
_TICK = f"({_BASE} + CAST('0x' || left(md5(CAST(site AS VARCHAR) || '@' || CAST({_BASE} AS VARCHAR)), 8) AS BIGINT) % {SPREAD + 1})"


@query(f"""WITH RECURSIVE lens AS (SELECT user_id AS site, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CAST(floor(value * 120) AS BIGINT) AS secs FROM events),
t AS (SELECT site, 0 AS n, {_TICK.format(n=0)} AS "at", 1 AS run, true AS fired, 0 AS dropped, {_TICK.format(n=0)} + secs AS busy FROM lens WHERE k = 1
UNION ALL SELECT s.site, s.n, s."at", CASE WHEN f THEN s.run + 1 ELSE s.run END, f, CASE WHEN f THEN 0 ELSE s.dropped + 1 END, CASE WHEN f THEN s."at" + l.secs ELSE s.busy END
 FROM (SELECT site, n + 1 AS n, {_TICK.format(n='(n + 1)')} AS "at", run, dropped, busy, {_TICK.format(n='(n + 1)')} >= busy AS f FROM t WHERE busy IS NOT NULL) s LEFT JOIN lens l ON l.site = s.site AND l.k = s.run + 1),
f AS (SELECT site, run, "at", n, n - coalesce(lag(n) OVER (PARTITION BY site ORDER BY run), -1) - 1 AS dropped FROM t WHERE fired)
SELECT site, CAST(run AS BIGINT) AS run, TIMESTAMP '1970-01-01' + to_seconds("at") AS "at", CAST(dropped AS BIGINT) AS dropped FROM f""")
def schedule_ticks(spark, sf_dir):
    """When the runs of every user's site start, half-hourly with jitter, if a run takes as long as the user's next event says; ticks during a run are dropped."""
    schedule.with_state_store(spark)
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    reports = table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.lit("*/30 * * * *").alias("schedule"), F.lit("2024-01-01").cast("timestamp").alias("since"), number.alias("no"), F.floor(F.col("value") * 120).alias("seconds"))
    return schedule.run_starts(reports, SPREAD)


@query("""WITH RECURSIVE w AS (SELECT DISTINCT user_id AS site, ts AS "at" FROM events WHERE event_type = 'error'),
r AS (SELECT site, min("at") AS "at" FROM w GROUP BY site UNION ALL SELECT r.site, min(w."at") AS "at" FROM r JOIN w ON w.site = r.site AND w."at" > r."at" + INTERVAL 6 HOUR GROUP BY r.site)
SELECT site, "at" FROM r""")
def reprofile_times(spark, sf_dir):
    """Weak runs that start a new profile, none within six hours of the last."""
    schedule.with_state_store(spark)
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.col("ts").alias("at"), (F.col("event_type") == "error").alias("weak"))
    return schedule.reprofile_times(runs)


_COUNTS = f"(SELECT page_id, count(*) AS n, count(*) FILTER (WHERE source = 'json' AND r <= 30) AS j, count(*) FILTER (WHERE source = 'anchor' AND r <= 30) AS a FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) AS r FROM ({_MERGED})) GROUP BY page_id)"
_MODE = "CASE WHEN j > 0 AND j >= a THEN 'embedded-json' ELSE 'anchors' END"
_HINT = "'\"hint\":\"auto-detected: ' || mode || ' (' || n || ' candidates)\",'"


@query(f"""SELECT site, mode, n AS candidates, mode <> 'anchors' OR k = 2 AS changed, CASE WHEN k = 0 AND mode = 'anchors' THEN '{{"title":"T","template":"generic","extract":{{"mode":"anchors","max":50,"hint":"x"}},"own":[1,{{"a":null}}]}}'
 WHEN k = 0 THEN '{{"title":"T","own":[1,{{"a":null}}],"template":"generic","extract":{{' || {_HINT} || '"max":50,"mode":"' || mode || '"}}}}'
 WHEN k = 1 AND mode = 'anchors' THEN '{{"template":"generic","extract":{{"mode":"anchors","followDepth":3,"follow":false}}}}'
 WHEN k = 1 THEN '{{"template":"generic","extract":{{"follow":false,' || {_HINT} || '"mode":"' || mode || '"}}}}'
 ELSE '{{"template":"generic","extract":{{' || {_HINT} || '"mode":"' || mode || '"}}}}' END AS config_json
FROM (SELECT {ORIGIN} || '#' || page_id AS site, page_id % 3 AS k, {_MODE} AS mode, n FROM pages JOIN {_COUNTS} USING (page_id))""")
def reprofiled_sites(spark, sf_dir):
    """Every page as the index of a site: its profile now, and what that makes of its settings, which can't be read for a third of them."""
    key = F.col("page_id")
    one = '{"title":"T","template":"generic","extract":{"mode":"anchors","max":50,"hint":"x"},"own":[1,{"a":null}]}'
    two = '{"template":"generic","extract":{"mode":"anchors","followDepth":3,"follow":false}}'
    config = F.when(key % 3 == 0, one).when(key % 3 == 1, two).otherwise("{bad")
    named = pages(spark, sf_dir).select("page_id", F.concat(urls.origin(F.col("url")), F.lit("#"), key.cast("string")).alias("site"), config.alias("config_json"))
    found = profile.profiles(sightings(spark, sf_dir)).join(named.select("page_id", "site"), "page_id").drop("page_id")
    return profile.reprofiled(named.select("site", "config_json"), found)
