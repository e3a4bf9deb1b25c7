"""A site's extraction profile: what its index page shows now, put into its settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.operators import discover

GENERIC = "generic"
#: Candidates of an index page that a profile looks at.
PROFILE_CANDIDATES = 400
#: Settings that a profile keeps if they differ from the instance's defaults, fixed names.
KNOBS = {"max": "100", "follow": "true", "followDepth": "3", "followUntil404": "false"}


def profiles(raw: DataFrame) -> DataFrame:
    """(page_id, mode, candidates) of index pages, of their raw candidates (see `discover.raw_candidates`). A page without candidates has no row."""
    merged = discover.merge_candidates(discover.score_candidates(raw), PROFILE_CANDIDATES)
    counts = merged.groupBy("page_id").agg(F.count("*").alias("candidates"))
    return discover.detect_mode(merged).join(counts, "page_id")


def extract_json(config: Column, mode: Column, candidates: Column, defaults: dict[str, str]) -> Column:
    """The extraction part of a profile: the mode, the knobs that differ from the defaults, and how it was found."""
    knobs = []
    for name, default in (KNOBS | defaults).items():
        own = F.get_json_object(config, f"$.extract.{name}")
        knobs.append(F.when(own.rlike("^(true|false|-?[0-9]+(\\.[0-9]+)?)$") & (own != default), F.concat(F.lit(f',"{name}":'), own)).otherwise(""))
    hint = F.concat(F.lit(',"hint":"auto-detected: '), mode, F.lit(" ("), candidates.cast("string"), F.lit(' candidates)"'))
    return F.concat(F.lit('{"mode":"'), mode, F.lit('"'), *knobs, hint, F.lit("}"))


def merged_config(config: Column, mode: Column, candidates: Column, defaults: dict[str, str] | None = None) -> Column:
    """The settings with a new profile in them: all other keys stay as they are. Settings that can't be read are as none."""
    own = F.coalesce(F.from_json(config, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    rest = F.map_filter(own, lambda k, _: ~k.isin("template", "extract"))
    new = F.from_json(F.concat(F.lit(f'{{"template":"{GENERIC}","extract":'), extract_json(config, mode, candidates, defaults or {}), F.lit("}")), "map<string,variant>")
    return F.to_json(F.map_concat(rest, new))


def reprofiled(sites: DataFrame, found: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """(site, mode, candidates, changed, config_json) of sites (site, config_json) with the profile of their index page (site, mode, candidates).

    The settings change only if the mode does, or if the site has another template than the generic one. A page without
    candidates leaves the mode to each run.
    """
    joined = sites.join(found, "site").withColumn("mode", F.coalesce("mode", F.lit("auto"))).withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    before = F.get_json_object("config_json", "$.extract.mode")
    template = F.get_json_object("config_json", "$.template")
    changed = ~before.eqNullSafe(F.col("mode")) | ~template.eqNullSafe(F.lit(GENERIC))
    config = F.when(changed, merged_config(F.col("config_json"), F.col("mode"), F.col("candidates"), defaults)).otherwise(F.col("config_json"))
    return joined.select("site", "mode", "candidates", changed.alias("changed"), config.alias("config_json"))
