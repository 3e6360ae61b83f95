"""Rule-hit jobs: the long prompt × rule table and the group roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matching import PART_BYTES  # noqa: F401  tests set it
from . import rule_tables as rt


def rule_hits(ruled: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per (prompt, matching rule), from the ``matched_rule_ids``
    computed by ``match_rules``; rule metadata is joined on."""
    dim = rules.select("rule_id", "layer", "grp", "category")
    # posexplode_outer + explicit filter: a plain explode lets the optimizer
    # infer size(array) > 0 and push it below the screening projection,
    # which would evaluate the whole pipeline twice.
    hits = (ruled.select("prompt_id", F.posexplode_outer("matched_rule_ids").alias("hit_pos", "rule_id"))
            .filter(F.col("rule_id").isNotNull()))
    return hits.join(dim, "rule_id")


def rule_hits_join(normalized: DataFrame, rules: DataFrame) -> DataFrame:
    """The same table for a pack of any size: (prompt_id, rule_id, layer, grp,
    category).  Rules and texts meet by joins (see ``rule_tables``): texts are
    computed once, and the pack is never on the driver or whole in a task."""
    texts = rt.numbered(normalized.select("prompt_id", F.col("normalized_text").alias("_text")), "_row", "rule-texts")
    pack = rt.enabled_rules(rules)
    found = rt.matches(texts.select("_row", "_text"), pack)
    return (found.join(texts.select("_row", "prompt_id"), "_row").join(pack, "_no")
            .select("prompt_id", "rule_id", "layer", "grp", "category"))


def rule_group_stats(ruled: DataFrame, rules: DataFrame) -> DataFrame:
    """Prompts and hits per layer × group with ROLLUP subtotals.  The
    distinct-prompt count is exact (count distinct over the partial
    aggregates, no sampling)."""
    return (rule_hits(ruled, rules)
            .rollup("layer", "grp")
            .agg(F.countDistinct("prompt_id").alias("prompts"), F.count("*").alias("hits")))
