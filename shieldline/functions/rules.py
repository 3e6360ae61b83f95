"""Rule packs and their matches.

A pack is read to the driver and matched by ``matching.rule_hits``: one
automaton over all anchors scans a text once, and candidates alone are matched.
``layer_hits`` is the same as a literal expression (``contains`` and ``rlike``
for each rule); tests hold the two against each other.  A pack that is too
large for a worker stays a table (``operators.rule_tables``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .matching import HIT_TYPE
from .regex import portable

RULE_FLAGS = "(?is)"      # case-insensitive, dot matches newline


@dataclass(frozen=True)
class Rule:
    rule_id: str
    layer: str
    grp: str
    category: str
    ord: int
    anchors: tuple[str, ...]
    pattern: str          # as written in the pack (Python syntax)

    @property
    def engine_pattern(self) -> str:
        """Portable form run by Spark (and by the DuckDB oracle)."""
        return RULE_FLAGS + portable(self.pattern)


@dataclass(frozen=True)
class RulePack:
    rules: tuple[Rule, ...]

    def layer(self, name: str) -> list[Rule]:
        return sorted((r for r in self.rules if r.layer == name), key=lambda r: r.ord)

    @staticmethod
    def from_df(rules_df: DataFrame) -> "RulePack":
        """The enabled rules of a table; those without a pattern match nothing
        and are left out.  Anchors are compared in lower case."""
        rows = rules_df.filter(F.col("enabled") & F.col("pattern").isNotNull()).collect()
        return RulePack(tuple(
            Rule(r.rule_id, r.layer, r.grp, r.category, int(r.ord or 0), tuple(a.lower() for a in r.anchors or () if a), r.pattern)
            for r in rows
        ))


def _gate(text: Column, anchors: tuple[str, ...]) -> Column:
    if not anchors:
        return F.lit(True)
    low = F.lower(text)
    g = None
    for a in anchors:
        c = low.contains(a)
        g = c if g is None else (g | c)
    return g


def rule_matches(text: Column, rule: Rule) -> Column:
    return _gate(text, rule.anchors) & text.rlike(rule.engine_pattern)


def layer_hits(text: Column, rules: list[Rule]) -> Column:
    """Array of hit structs, in pack order, as one literal expression."""
    if not rules:
        return F.array().cast(f"array<{HIT_TYPE}>")
    items = [
        F.when(rule_matches(text, r), F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.pattern).alias("pattern"),
            F.lit(r.category).alias("category"), F.lit(r.grp).alias("grp")))
        for r in rules
    ]
    return F.array_compact(F.array(*items))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def layer_summary(hits: Column) -> dict[str, Column]:
    first = F.try_element_at(hits, F.lit(1))
    return {
        "fired": F.size(hits) > 0,
        "first": first["pattern"],
        "category": F.when(F.size(hits) > 0, F.coalesce(first["category"], F.lit(fv.CATEGORY_UNKNOWN)))
                     .otherwise(F.lit(fv.CATEGORY_NONE)),
        "match_count": F.size(hits),
        "display": F.transform(F.slice(hits, 1, 3), lambda h: truncate(h["pattern"], fv.MATCH_DISPLAY_LEN)),
    }


def all_matched(ar_hits: Column, en_hits: Column) -> Column:
    return F.array_distinct(F.concat(F.transform(ar_hits, lambda h: h["pattern"]),
                                     F.transform(en_hits, lambda h: h["pattern"])))
