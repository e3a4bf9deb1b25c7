"""Tables of the content store. `items` holds what a file-based store would keep beside it: content, raw page, metadata, LLM fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

METADATA = "struct<title:string,author:string,publishedAt:string,image:string,canonical:string,ogUrl:string>"
LLM = "struct<title:string,html:string,text:string,url:string,publishedAt:string,model:string,extractedAt:timestamp>"
QUALITY = "struct<parsed:int,bodyGood:int,dateGood:int>"
CONFIG = (
    "struct<title:string,description:string,template:string,ignore_images:boolean,"
    "scrape_delay:struct<lower_sec:double,upper_sec:double>,"
    "extract:struct<mode:string,max:int,follow:int,followDepth:int,followUntil404:boolean,waitMs:int,"
    "ad_markers:array<string>,paywall_markers:array<string>,storeRaw:boolean,llm:boolean,feedSource:string,hint:string>>"
)

SITES = "site string, url string, title string, description string, schedule string, config_json string, module_path string, private boolean, created_at timestamp, last_scrape_at timestamp, last_scrape_status string, last_error string"
SECTIONS = "site string, section string, index_url string, title string, description string, created_at timestamp"
ITEMS = f"site string, hash string, url string, title string, published_at timestamp, first_seen timestamp, content_hash string, content_html string, text string, raw_html string, author string, image string, metadata {METADATA}, llm {LLM}"
ITEM_SECTIONS = "site string, section string, hash string"
RUNS = f"id string, site string, started_at timestamp, finished_at timestamp, status string, discovered long, new_items long, failed long, paywalled long, skipped long, error string, log_excerpt string, quality {QUALITY}"
#: Changes of key values, in the order of `at`; a null value deletes.
KV = "site string, key string, value string, at timestamp"
#: Pages without an article; those to `retry` are for another engine.
FAILURES = "run string, site string, section string, url string, page_id long, error string, retry boolean"
#: Runs whose pages have been judged, so that a batch that is tried again goes on from there.
DECIDED = "run string"

TABLES = {"sites": SITES, "sections": SECTIONS, "items": ITEMS, "item_sections": ITEM_SECTIONS, "runs": RUNS, "kv": KV, "failures": FAILURES, "decided": DECIDED}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """`df` with the columns of the schema: those it lacks are null, others go, and types are cast. This is how old data is read."""
    return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)))
