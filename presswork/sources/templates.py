"""Discovery templates as table functions: what a page of a site gives, by the template that the site names.

A template is a function of a parsed page and its address. Each is registered in Spark as a table function `discover_<template>`, which takes a
table of pages, partitioned by site, and gives raw candidates as `discover.score_candidates` takes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from presswork.functions import html, urls

Candidate = tuple[str, str | None, str | None, str]
CANDIDATES = StructType().add("page_id", LongType()).add("index_url", StringType()).add("ord", IntegerType()).add("url", StringType()).add("title", StringType()).add("date", StringType()).add("source", StringType())
NEEDED = ("site", "page_id", "url", "html")
#: Tasks among which the pages of one site are dealt, since a site may have any share of all pages.
PARTS = 16


def links(root: html.Node, base: str) -> list[Candidate]:
    return [(url, text, None, "anchor") for url, text in html.anchors(root, base)]


def records(root: html.Node, base: str) -> list[Candidate]:
    return list(html.embedded_records(root, base))


def generic(root: html.Node, base: str) -> list[Candidate]:
    return [*links(root, base), *records(root, base)]


TEMPLATES: dict[str, Callable[[html.Node, str], list[Candidate]]] = {"generic": generic, "anchors": links, "embedded_json": records}


def table_function(template: str) -> type:
    """The class of the template's table function."""
    own = TEMPLATES[template]

    class Discover:
        @staticmethod
        def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
            if not pages.isTable or (missing := [c for c in NEEDED if c not in pages.dataType.fieldNames()]):
                raise ValueError(f"a table of pages is needed, with the columns {', '.join(NEEDED)}" if not pages.isTable else f"the pages lack {', '.join(missing)}")
            parts = ["site", *(c for c in ("part",) if c in pages.dataType.fieldNames())]
            return AnalyzeResult(CANDIDATES, partitionBy=[PartitioningColumn(c) for c in parts], orderBy=[OrderingColumn("page_id")])

        def eval(self, page: Row) -> Iterator[tuple]:
            # As in `html.page_links`: a page without an address or markup gives nothing.
            if page.html and page.url:
                for i, candidate in enumerate(own(html.parse(page.html), page.url)):
                    yield (page.page_id, page.url, i, *candidate)

    return Discover


def register(spark: SparkSession) -> list[str]:
    """Registers all templates for SQL: SELECT * FROM discover_generic(TABLE(pages)). Their names."""
    for template in TEMPLATES:
        spark.udtf.register(f"discover_{template}", F.udtf(table_function(template)))
    return [f"discover_{t}" for t in TEMPLATES]


def discover_pages(pages: DataFrame, template: str = "generic") -> DataFrame:
    """Raw candidates of pages (site, page_id, url, html), by the table function of the template. A site's pages go to several tasks."""
    dealt = pages.select(*NEEDED, F.pmod(F.xxhash64("page_id"), F.lit(PARTS)).alias("part"))
    return F.udtf(table_function(template))(dealt.asTable())


def of_sites(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Raw candidates of all pages, each by its site's template (site, template); sites without one, or of an unknown one, are generic."""
    named = pages.join(sites.select("site", "template").dropDuplicates(["site"]), "site", "left")
    template = F.when(F.col("template").isin(*TEMPLATES), F.col("template")).otherwise("generic")
    out = [discover_pages(named.where(template == t), t) for t in TEMPLATES]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def by_host(pages: DataFrame) -> DataFrame:
    """Pages with their host as the site."""
    return pages.withColumn("site", urls.host(F.col("url")))
