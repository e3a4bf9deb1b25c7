"""Article candidates of index pages: scores, merging per address, page mode, and links to follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions import dates, text, urls
from presswork.session import stored

# Link texts that promise more articles.
FOLLOW_TEXT = r"see\s*all|view\s*all|show\s*more|load\s*more|all\s*news|more\s*(news|articles|stories|headlines)|latest\s*news|\barchive\b|\bnews\b|\bart'?icles?\b|stories|headlines|listing|^[0-9]+\s*$|\bnext\b"


def raw_candidates(pages: DataFrame) -> DataFrame:
    """(page_id, index_url, ord, url, title, date, source) of pages with parsed `fields` (anchors and records): anchors first, then embedded records.

    Both kinds are one array before they become rows, so a page's fields are made once.
    """
    none = F.lit(None).cast("string")
    links = F.transform("fields.anchors", lambda a: F.struct(a.url.alias("url"), a.text.alias("title"), none.alias("date"), F.lit("anchor").alias("source")))
    both = pages.select("page_id", F.col("url").alias("index_url"), F.posexplode(F.concat(links, "fields.records")).alias("ord", "c"))
    return both.select("page_id", "index_url", "ord", "c.url", "c.title", "c.date", "c.source")


def score_candidates(raw: DataFrame, mode: str = "auto") -> DataFrame:
    """Raw candidates that may be articles of their page's origin, with the date and title found, score and acceptance."""
    url = F.col("url")
    kept = raw.where((urls.origin(url) == urls.origin(F.col("index_url"))) & urls.is_usable(url) & (urls.bare_path(url) != urls.bare_path(F.col("index_url"))))
    if mode == "embedded-json":
        kept = kept.where("source <> 'anchor'")
    elif mode == "anchors":
        kept = kept.where("source = 'anchor' OR date IS NOT NULL")
    lead = dates.leading_date(F.col("title"))
    dated = kept.withColumn("lead", lead).withColumn("trail", dates.trailing_date(F.when(F.col("lead").isNull(), F.col("title"))))
    found = dated.withColumn("found", F.coalesce("date", dates.path_date(urls.path(url)), "lead.iso", "trail.iso"))
    clean = F.when(F.col("date").isNotNull(), F.col("title")).otherwise(F.coalesce("lead.rest", "trail.rest", "title"))
    path = urls.path_score(url)
    score = path + text.text_score(clean) + F.when(F.col("found").isNotNull(), 15).otherwise(0) + text.source_bonus(F.col("source"))
    accept = (path >= 30) | (text.text_score(F.col("title")) >= 12) | (score >= 30) | (F.col("source").isin("json", "jsonld") & (F.col("found").isNotNull() | (path >= 20)))
    return found.select("page_id", "ord", urls.normalize_url(url).alias("url"), clean.alias("title"), F.col("found").alias("date"), "source", score.alias("score"), accept.alias("accept"))


def merge_candidates(scored: DataFrame, most: int = 100) -> DataFrame:
    """One row per page and address, the best `most` of each page.

    The first accepted sighting gives source, title and date; later sightings, accepted or not, fill what is
    empty and can raise the score. What came before the first accepted one counts for nothing.
    """
    # The first accepted place is a running value over the sightings of one address of one page.
    sight = Window.partitionBy("page_id", "url").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    live = scored.withColumn("since", F.min(F.when(F.col("accept"), F.col("ord"))).over(sight)).where("since IS NOT NULL")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("ord")))
    merged = live.groupBy("page_id", "url").agg(first("title").alias("title"), first("date").alias("date"), F.min_by("source", "ord").alias("source"), F.max("score").alias("score"), F.min("ord").alias("ord"))
    best = Window.partitionBy("page_id").orderBy(F.desc("score"), "ord")
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= (most or 100))


def merge_pages(merged: DataFrame, group: str, most: int = 100) -> DataFrame:
    """Candidates of all index pages of a group (a site or section), one row per address: the first page that has it wins, then the best score counts.

    merged: as `merge_candidates` gives it, with the group's column; page_id tells the order of pages.
    """
    one = merged.groupBy(group, "url").agg(F.min_by(F.struct("page_id", "title", "date", "source", "score", "ord"), "page_id").alias("m"))
    best = Window.partitionBy(group).orderBy(F.desc("m.score"), "m.page_id", "m.ord", "url")
    return one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= (most or 100)).select(group, "url", "m.page_id", "m.title", "m.date", "m.source", "m.score", "rank")


def detect_mode(merged: DataFrame) -> DataFrame:
    """(page_id, mode): which kind of source most of a page's 30 best candidates have."""
    top = merged.where("rank <= 30").groupBy("page_id").agg(F.count_if(F.col("source").isin("json", "uri-regex")).alias("json"), F.count_if(F.col("source") == "anchor").alias("anchors"))
    mode = F.when((F.col("json") > 0) & (F.col("json") >= F.col("anchors")), "embedded-json").when(F.col("anchors") > 0, "anchors").otherwise("auto")
    return top.select("page_id", mode.alias("mode"))


def follow_links(links: DataFrame, most: int = 6) -> DataFrame:
    """The first `most` links of each page that lead to further listings. links: page_id, index_url, ord, url, title."""
    url, index = F.col("url"), F.col("index_url")
    segs = urls.segments(index)
    lead = F.when(F.try_element_at(segs, F.lit(1)).rlike(r"(?i)\.[a-z0-9]+$"), F.try_element_at(segs, F.lit(2))).otherwise(F.try_element_at(segs, F.lit(1)))
    root = F.when(lead.isNotNull(), F.concat(F.lit("/"), lead)).otherwise("")
    number, now = urls.page_number(url), F.coalesce(urls.page_number(index), F.lit(1))
    shallow = F.size(urls.segments(url)) <= 2
    kept = links.where(
        (urls.origin(url) == urls.origin(index))
        & ~urls.is_article_like(url)
        & ((root == "") | F.concat(urls.bare_path(url), F.lit("/")).startswith(F.concat(root, F.lit("/"))))
        & (number.isNull() | (number == now + 1))
        & (urls.is_listing_like(url) | (shallow & F.lower(F.col("title")).rlike(FOLLOW_TEXT)))
        & (urls.normalize_url(url) != urls.normalize_url(index))
    )
    unique = kept.groupBy("page_id", urls.normalize_url(url).alias("url")).agg(F.min("ord").alias("ord"), F.min_by(text.cut(F.col("title"), "label"), "ord").alias("label"))
    order = Window.partitionBy("page_id").orderBy("ord")
    return unique.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("page_id", "url", "label", "ord")


def frontier(edges: DataFrame, seeds: DataFrame, depth: int = 8, most: int = 40, seen_levels: list[int] | None = None) -> DataFrame:
    """(site, url, level) of pages reached over edges (site, src, dst) from seeds (site, url), by levels; at most `most` of each site, nearest first.

    One join a level. A site that has its pages leaves the levels, as all later pages are farther. Edges and levels are written, so that no
    level redoes the ones before it; nothing comes to the driver but how many rows a level has (`seen_levels` takes them). Edges are written
    as they come: a level drops repeats among the few that it reaches, where a task would hold its share of all edges for that.
    """
    edges = stored(edges.select("site", "src", "dst"))
    level = seen = stored(seeds.select("site", "url", F.lit(0).alias("level")).distinct())
    counts = level.groupBy("site").agg(F.count("*").alias("n"))
    for n in range(1, depth + 1):
        going = level.join(counts.where(F.col("n") < most), "site", "left_semi")
        step = going.join(edges, (going.site == edges.site) & (going.url == edges.src)).select(going.site, F.col("dst").alias("url")).distinct()
        level = stored(step.join(seen, ["site", "url"], "left_anti").withColumn("level", F.lit(n)))
        rows = level.count()
        if seen_levels is not None:
            seen_levels.append(rows)
        if not rows:
            break
        seen = seen.unionByName(level)
        counts = stored(counts.unionByName(level.groupBy("site").agg(F.count("*").alias("n"))).groupBy("site").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("site").orderBy("level", "url")
    return seen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def crawl(links: DataFrame, found: DataFrame, seeds: DataFrame, most: int = 100, pages: int = 40, follow: int = 3, to_the_end: bool = False, read: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(site, url, place, level) of the listings that a crawl reads, and (site, candidate, place, ord) of the candidates that it merges, each at its first sighting.

    links (site, src, ord, dst): what a listing leads on to (see `follow_links`: of page numbers only the next one). found (site, url, ord,
    candidate). seeds (site, url): one a site. Listings are read in the order in which they are come across, that is by levels, within a
    level by the listing that leads to them and by its order. A site stops when it has `most` candidates or `pages` listings. Only the
    first `follow` listings after the seed lead on, or all of them `to_the_end`.

    A level of all sites is one step; sites that have stopped aren't in it. A site has `pages` listings in hand at most. `read` takes
    the number of listings of each level. Links and candidates are written, so that all levels see the same ones, whatever they are made of.
    """
    links = stored(links.select("site", "src", "ord", "dst").where("dst IS NOT NULL"))
    found = stored(found.select("site", "url", "ord", "candidate").where("candidate IS NOT NULL"))
    level = stored(seeds.groupBy("site").agg(F.min("url").alias("url")).select("site", "url", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("total")))
    queued = level.select("site", "url")
    visited, merged, number = None, None, 0
    while True:
        sightings = level.join(found, ["site", "url"])
        fresh = sightings if merged is None else sightings.join(merged, ["site", "candidate"], "left_anti")
        first = stored(fresh.groupBy("site", "candidate").agg(F.min(F.struct("place", "ord")).alias("at")).select("site", "candidate", "at.place", "at.ord"))
        gains = first.groupBy("site", "place").agg(F.count("*").alias("gain"))
        before = Window.partitionBy("site").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        counted = level.join(gains, ["site", "place"], "left").withColumn("had", F.col("total") + F.coalesce(F.sum("gain").over(before), F.lit(0)))
        own = stored(counted.where((F.col("had") < most) & (F.col("place") < pages)).select("site", "url", "place", (F.col("had") + F.coalesce("gain", F.lit(0))).alias("has")))
        if read is not None:
            read.append(own.count())
        step = own.select("site", "url", "place", F.lit(number).alias("level"))
        visited = step if visited is None else visited.unionByName(step)
        taken = first.join(own.select("site", "place"), ["site", "place"], "left_semi").select("site", "candidate", "place", "ord")
        merged = taken if merged is None else merged.unionByName(taken)
        state = own.groupBy("site").agg(F.max("has").alias("total"))
        leading = own if to_the_end else own.where(F.col("place") <= follow)
        reached = leading.join(links, (leading.site == links.site) & (leading.url == links.src)).groupBy(leading.site, F.col("dst").alias("url")).agg(F.min(F.struct("place", "ord")).alias("by"))
        new = reached.join(queued, ["site", "url"], "left_anti")
        known = queued.groupBy("site").agg(F.count("*").alias("known"))
        order = Window.partitionBy("site").orderBy("by", "url")
        placed = new.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= pages).join(known, "site").join(state.where(F.col("total") < most), "site")
        level = stored(placed.select("site", "url", (F.col("known") + F.col("nth") - 1).alias("place"), "total"))
        if level.isEmpty():
            return visited, merged
        queued = stored(queued.unionByName(level.select("site", "url")))
        number += 1


def site_of(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Pages with the `site` that their address's origin belongs to; null where no site has it. sites: site, url. Of several the least counts."""
    own = sites.select(urls.origin(F.col("url")).alias("_origin"), "site").where("_origin IS NOT NULL").groupBy("_origin").agg(F.min("site").alias("site"))
    return pages.withColumn("_origin", urls.origin(F.col("url"))).join(own, "_origin", "left").drop("_origin")


def link_inventory(raw: DataFrame) -> DataFrame:
    """Every address of a page once, with the text it is first seen with (90 characters)."""
    return raw.groupBy("page_id", "url").agg(F.min("ord").alias("ord"), F.min_by(text.cut(F.coalesce("title", F.lit("")), "link"), "ord").alias("text"))


def listing_filter(pages: DataFrame, sections: DataFrame, path: Column) -> DataFrame:
    """Pages of a site whose path isn't one of its section indexes. `path`: of a page; sections have site and path."""
    return pages.withColumn("_p", path).join(sections.select("site", F.col("path").alias("_p")).distinct(), ["site", "_p"], "left_anti").drop("_p")
