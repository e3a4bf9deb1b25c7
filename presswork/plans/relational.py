"""The relational core on the driver's tables: items are orders, memberships line items, sites customers, runs and key values events."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswork.functions import dates, records, text
from presswork.operators import feeds, items, quality
from presswork.plans.registry import query, table

FEED_SQL = "(o_totalprice > 400000), CASE WHEN o_totalprice > 400000 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END DESC, o_orderdate + INTERVAL 1 DAY DESC, o_orderkey"


def as_items(orders):
    """Orders as items: the costly ones are undated, and all are first seen a day after their date."""
    seen = F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")
    return orders.select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("hash"), F.when(F.col("o_totalprice") <= 400000, F.col("o_orderdate")).alias("published_at"), seen.alias("first_seen"), "o_orderpriority", "o_totalprice")


ITEMS_SQL = "(SELECT o_custkey AS site, o_orderkey AS hash, CASE WHEN o_totalprice <= 400000 THEN o_orderdate END AS published_at, o_orderdate + INTERVAL 1 DAY AS first_seen, o_orderpriority, o_totalprice FROM orders)"
ORDER_SQL = "(published_at IS NULL), coalesce(published_at, first_seen) DESC, first_seen DESC, hash"


@query(f"SELECT site, hash, published_at, first_seen FROM {ITEMS_SQL} WHERE hash IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7) ORDER BY {ORDER_SQL} LIMIT 10")
def section_feed_topk(spark, sf_dir):
    """The ten first items of one section: a left semi join and a top-k."""
    members = table(spark, sf_dir, "lineitem").where("l_suppkey = 7").select(F.col("l_orderkey").alias("hash"))
    own = items.section_items(as_items(table(spark, sf_dir, "orders")), members, ["hash"])
    return feeds.top_items(own, 10).select("site", "hash", "published_at", "first_seen")


@query(f"SELECT site, hash, CAST(row_number() OVER (PARTITION BY site ORDER BY {ORDER_SQL}) AS INTEGER) AS rank FROM {ITEMS_SQL} QUALIFY row_number() OVER (PARTITION BY site ORDER BY {ORDER_SQL}) <= 10")
def feed_topk_per_site(spark, sf_dir):
    return feeds.top_items_per(as_items(table(spark, sf_dir, "orders")), ["site"], 10).select("site", "hash", "rank")


@query(f"SELECT hash, published_at, coalesce(published_at, first_seen) AS shown_at FROM {ITEMS_SQL} ORDER BY {ORDER_SQL} LIMIT 50")
def undated_last_order(spark, sf_dir):
    out = feeds.top_items(as_items(table(spark, sf_dir, "orders")), 50)
    return out.select("hash", "published_at", F.coalesce("published_at", "first_seen").alias("shown_at"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_items(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return items.orphans(table(spark, sf_dir, "orders"), members, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("""SELECT 'customer' AS child, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def cascade_delete_counts(spark, sf_dir):
    """Children left when the parents of one region go."""
    gone = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("k"))
    children = {"customer": table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), "supplier": table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))}
    left = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "n") for name, df in items.cascade(children, gone, "k").items()]
    return left[0].unionByName(left[1])


@query("""SELECT DISTINCT l_suppkey AS section, l_orderkey AS hash FROM lineitem
EXCEPT SELECT l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R'""")
def membership_insert_ignore(spark, sf_dir):
    """Memberships to append: those of a batch that aren't there yet, each once."""
    keyed = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("section"), F.col("l_orderkey").alias("hash"), "l_returnflag")
    return items.insert_ignore(keyed, keyed.where("l_returnflag = 'R'"), ["section", "hash"])


@query("""SELECT o_orderkey AS hash, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 5) THEN 'known' ELSE 'new' END AS outcome FROM orders""")
def known_new_split(spark, sf_dir):
    """A batch against the store: what is known only gets a membership, the rest is new."""
    orders = table(spark, sf_dir, "orders").select(F.lit("s").alias("site"), F.col("o_orderkey").alias("hash"))
    store = table(spark, sf_dir, "lineitem").where("l_linenumber = 5").select(F.lit("s").alias("site"), F.col("l_orderkey").alias("hash"))
    known, new = items.split_known(orders, store)
    return known.select("hash", F.lit("known").alias("outcome")).unionByName(new.select("hash", F.lit("new").alias("outcome")))


@query("""SELECT DISTINCT l_suppkey AS section, l_orderkey AS hash FROM lineitem
EXCEPT SELECT l_suppkey, l_orderkey FROM lineitem WHERE l_linenumber <= 1""")
def membership_insert_ignore_all(spark, sf_dir):
    """The same with the whole table as the batch."""
    keyed = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("section"), F.col("l_orderkey").alias("hash"), "l_linenumber")
    return items.insert_ignore(keyed, keyed.where("l_linenumber <= 1"), ["section", "hash"])


@query("""SELECT o_orderkey AS hash, CASE WHEN o_orderstatus = 'F' THEN 'known' ELSE 'new' END AS outcome FROM orders""")
def known_new_split_all(spark, sf_dir):
    """The whole table against the store, which has the orders of status F."""
    orders = table(spark, sf_dir, "orders").select(F.lit("s").alias("site"), F.col("o_orderkey").alias("hash"), "o_orderstatus")
    known, new = items.split_known(orders.drop("o_orderstatus"), orders.where("o_orderstatus = 'F'").drop("o_orderstatus"))
    return known.select("hash", F.lit("known").alias("outcome")).unionByName(new.select("hash", F.lit("new").alias("outcome")))


@query("""SELECT l_orderkey AS hash, min(l_linenumber) AS first_line FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey""")
def insert_once(spark, sf_dir):
    """New rows, one of each key, that the store doesn't have."""
    new = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_linenumber").alias("first_line"))
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("hash"))
    return items.insert_once(new, known, ["hash"], "first_line")


@query("""WITH gone AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 3 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey <> 3))
SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM gone)) AS items, (SELECT count(*) FROM lineitem WHERE l_suppkey <> 3) AS memberships""")
def remove_section(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.lit("s").alias("site"), F.col("o_orderkey").alias("hash"))
    members = table(spark, sf_dir, "lineitem").select(F.lit("s").alias("site"), F.col("l_suppkey").cast("string").alias("section"), F.col("l_orderkey").alias("hash"))
    left, rest = items.remove_section(orders, members, "s", "3")
    # Two counts in one row: one aggregation over both, no join without a key.
    both = left.select(F.lit("items").alias("kind")).unionByName(rest.select(F.lit("memberships").alias("kind")))
    return both.agg(F.count_if(F.col("kind") == "items").alias("items"), F.count_if(F.col("kind") == "memberships").alias("memberships"))


@query("""SELECT c_custkey AS site, coalesce(s.n, 0) AS n_sections, least(coalesce(i.n, 0), 100000) AS n_items FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) i ON i.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1) s ON s.o_custkey = c_custkey""")
def site_status_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "site")
    sites = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"))
    return feeds.site_status(sites, orders.select("site", "o_orderpriority").distinct(), orders)


@query("""SELECT o_custkey AS site, '{"site":' || o_custkey || ',"n_sections":' || count(DISTINCT o_orderpriority) || ',"n_items":' || least(count(*), 100000) || '}' AS status FROM orders GROUP BY o_custkey""")
def status_json(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "site")
    return feeds.status_json(feeds.site_status(orders.select("site").distinct(), orders.select("site", "o_orderpriority").distinct(), orders))


@query("SELECT count(*) AS n_items, count(DISTINCT o_custkey) AS n_sites FROM orders")
def grand_total(spark, sf_dir):
    return feeds.grand_total(as_items(table(spark, sf_dir, "orders")))


@query("""SELECT l_suppkey AS section, count(DISTINCT l_orderkey) AS n_items FROM lineitem GROUP BY l_suppkey""")
def section_counts(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("section"), F.col("l_orderkey").alias("hash"))
    return feeds.section_counts(members, ["section"])


@query(f"SELECT site, max(first_seen) AS built_at FROM (SELECT * FROM {ITEMS_SQL} QUALIFY row_number() OVER (PARTITION BY site ORDER BY {ORDER_SQL}) <= 10) GROUP BY site")
def last_build_date(spark, sf_dir):
    """The latest first sighting among the served items."""
    return feeds.top_items_per(as_items(table(spark, sf_dir, "orders")), ["site"], 10).groupBy("site").agg(F.max("first_seen").alias("built_at"))


@query("SELECT user_id, event_type, max_by(props, event_id) AS props FROM events GROUP BY user_id, event_type HAVING max_by(value, event_id) >= 1")
def kv_upsert_latest(spark, sf_dir):
    """A key-value table from its changes; a last value under 1 deletes the key."""
    changes = table(spark, sf_dir, "events").select("user_id", "event_type", F.when(F.col("value") >= 1, F.col("props")).alias("props"), "event_id")
    return items.latest_values(changes, ["user_id", "event_type"], "props", "event_id")


@query("""SELECT user_id AS site, max_by(value, event_id) AS last_value FROM events WHERE event_type = 'view' GROUP BY user_id
UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'view')""")
def row_updates(spark, sf_dir):
    """Sites with what changed in place of what was."""
    sites = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), F.col("c_acctbal").alias("last_value"))
    changes = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("site"), F.col("value").alias("last_value"), "event_id")
    return items.upsert(sites, items.latest_values(changes, ["site"], "last_value", "event_id"), ["site"])


@query("SELECT user_id AS site, event_id, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INTEGER) AS rank FROM events QUALIFY rank <= 20")
def recent_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), "event_id", "ts")
    return quality.recent_runs(runs, 20, F.desc("event_id"))


@query("""SELECT source, parsed, body_ok, date_ok, body_ok / parsed AS body_rate, date_ok / parsed AS date_rate, (body_ok / parsed < 0.6 OR date_ok / parsed < 0.6) AS weak,
 'body ' || body_ok || '/' || parsed || ', date ' || date_ok || '/' || parsed AS quality
FROM (SELECT source, count(*) AS parsed, count(*) FILTER (WHERE length(trim(text)) >= 200) AS body_ok, count(*) FILTER (WHERE coalesce(quality, 0) = 1) AS date_ok
 FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)""")
def run_quality_rates(spark, sf_dir):
    marked = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = marked.select("source", text.body_good(F.col("text")).alias("body_good"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("date_good"))
    out = quality.run_quality(rows, ["source"])
    return out.withColumn("quality", quality.quality_text(F.col("body_ok"), F.col("date_ok"), F.col("parsed")))


@query("""SELECT user_id AS site, count(*) AS discovered, count(*) FILTER (WHERE event_type = 'signup') AS new_items, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'view') AS skipped,
CASE WHEN count(*) FILTER (WHERE event_type = 'error' AND value > 120) > 0 THEN 'error' WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'partial' ELSE 'ok' END AS status FROM events GROUP BY user_id""")
def run_status(spark, sf_dir):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("site")).agg(F.count("*").alias("discovered"), kind("signup").alias("new_items"), kind("error").alias("failed"), kind("view").alias("skipped"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 120)).alias("fatal"))
    return counts.withColumn("status", quality.run_status(F.col("fatal") > 0, F.col("discovered"), F.col("failed"))).drop("fatal")


@query("""SELECT site, min_by(props, n) AS error, left(string_agg(props, chr(10) ORDER BY n), 2000) AS log_excerpt
FROM (SELECT user_id AS site, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error') WHERE n <= 5 GROUP BY site""")
def error_excerpts(spark, sf_dir):
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("site"), "event_id", "props")
    return quality.error_excerpt(errors, ["site"], "event_id", "props")


@query("SELECT event_type AS outcome, count(*) AS n, count(*) FILTER (WHERE value > 20) AS n_slow FROM events GROUP BY event_type")
def outcome_counts(spark, sf_dir):
    return quality.outcome_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "outcome"), n_slow=F.col("value") > 20)


@query("SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') AS pub_date FROM orders")
def rfc822_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.rfc822(F.col("o_orderdate")).alias("pub_date"))


@query(f"""SELECT site, string_agg('    <item>' || chr(10) || '      <title>' || replace(replace('P&' || o_orderpriority, '&', '&amp;'), '<', '&lt;') || '</title>' || chr(10) || '      <link>https://shop.example/' || hash || '</link>' || chr(10)
 || '      <guid isPermaLink="false">' || hash || '</guid>' || chr(10) || '      <pubDate>' || strftime(coalesce(published_at, first_seen), '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate>' || chr(10)
 || '      <description/>' || chr(10) || '    </item>' || chr(10), '' ORDER BY rank) AS items
FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {ORDER_SQL}) AS rank FROM {ITEMS_SQL} QUALIFY rank <= 10) GROUP BY site""")
def rss_items_xml(spark, sf_dir):
    top = feeds.top_items_per(as_items(table(spark, sf_dir, "orders")), ["site"], 10)
    none = F.lit(None).cast("string")
    item = feeds.rss_item(F.concat(F.lit("P&"), "o_orderpriority"), F.concat(F.lit("https://shop.example/"), F.col("hash").cast("string")), F.col("hash").cast("string"), F.coalesce("published_at", "first_seen"), none, none, none)
    return feeds.join_items(top.withColumn("item", item), ["site"], "item")


@query("SELECT n_nationkey, CASE WHEN ends_with(lower(r_name || ' ' || n_name), lower(n_name)) AND n_nationkey % 2 = 0 THEN r_name || ' ' || n_name ELSE r_name || ' - ' || n_name END AS title FROM nation JOIN region ON n_regionkey = r_regionkey")
def feed_titles(spark, sf_dir):
    """Section feeds' titles; the small side is left to Spark's own size check."""
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    site = F.when(F.col("n_nationkey") % 2 == 0, F.concat("r_name", F.lit(" "), "n_name")).otherwise(F.col("r_name"))
    return joined.select("n_nationkey", text.feed_title(site, F.col("n_name")).alias("title"))


@query("SELECT user_id, event_id, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 10) AS max_items, CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) <> 10 THEN '{\"max\":' || json_extract(props, '$.k') || '}' ELSE '{}' END AS knobs FROM events")
def config_knobs(spark, sf_dir):
    """A typed setting over its default, and only what differs, as JSON."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("user_id", "event_id", records.knob(k, 10).alias("max_items"), records.profile_json(max=(k, 10)).alias("knobs"))
