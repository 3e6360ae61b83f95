"""Rules as a table: matching a pack of any size without the driver.

A pack that is larger than one worker stays a table, and meets the texts by
joins.  An anchor occurs in a text only if its longest piece between blanks
occurs within one of the text's tokens (runs without a blank), so

1. texts are read once into their distinct folded tokens;
2. of every distinct token the pieces of ``KEY_CHARS`` characters (and those of
   the shorter lengths that anchors have) meet the anchors' beginnings;
3. what a token holds comes back to the texts with it as lists of rules;
4. each text is asked for its candidates: the whole anchor, then the pattern,
   as ``matching.Rules`` does.

Rules without such a piece are candidates for every text.  Lists are cut into
``LIST_RULES`` rules of a token, so that an anchor of a whole pack is no row of
its size.  Texts and rules are named by numbers given when they are written:
rows that repeat an id, or have none, are rows like others.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import matching as mt
from ..functions.rules import Rule
from ..session import written

#: Characters by which tokens and anchors meet.
KEY_CHARS = 8
#: Rules of a token in one row.
LIST_RULES = 256


@F.arrow_udf(T.ArrayType(T.StringType()))
def _tokens(texts: pa.Array) -> pa.Array:
    """The distinct tokens of folded texts."""
    kind = pa.list_(pa.string())
    out = [pa.array([[] if t is None else sorted(set(mt.folded(t).split(" ")) - {""}) for t in s.to_pylist()], kind) for s in mt.slices(texts)]
    return pa.concat_arrays(out) if out else pa.array([], kind)


@F.arrow_udf(T.StructType([T.StructField("anchor", T.StringType()), T.StructField("key", T.StringType())]))
def _keyed(anchors: pa.Array) -> pa.Array:
    """Anchors as they are compared, and their longest pieces between blanks."""
    own = [mt.folded((a or "").lower()) for a in anchors.to_pylist()]
    return pa.array([{"anchor": a, "key": max(a.split(" "), key=len)} for a in own], pa.struct([("anchor", pa.string()), ("key", pa.string())]))


@lru_cache(maxsize=1 << 16)
def _engine_pattern(pattern: str) -> str:
    return Rule("", "", "", "", 0, (), pattern).engine_pattern


@F.arrow_udf(T.ArrayType(T.LongType()))
def _matching(texts: pa.Array, lists: pa.Array) -> pa.Array:
    """The numbers of the listed rules that match a text, ascending."""
    out: list[list[int]] = []
    for s in mt.slices(texts):
        own = lists.slice(len(out), len(s))
        size = np.array([0 if x is None else x for x in own.value_lengths().to_pylist()], dtype=np.int64)
        row, flat = np.repeat(np.arange(len(s)), size), own.flatten()
        rows = s.to_pylist()
        low = ["" if t is None else mt.folded(t) for t in rows]
        held = [rows[i] is not None and a in low[i] for i, a in zip(row.tolist(), flat.field("anchor").to_pylist())]
        at = np.flatnonzero(np.array(held, dtype=bool))
        no = flat.field("no").to_numpy(zero_copy_only=False).astype(np.int64)
        at = at[np.lexsort((row[at], no[at]))]  # rule by rule
        same = np.concatenate([[False], (no[at][1:] == no[at][:-1]) & (row[at][1:] == row[at][:-1])]) if len(at) else np.zeros(0, dtype=bool)
        at = at[~same]  # several anchors of a rule
        patterns = flat.field("pattern").take(pa.array(at)).to_pylist()
        found: list[list[int]] = [[] for _ in rows]
        first = np.concatenate([[0], np.flatnonzero(np.diff(no[at])) + 1, [len(at)]]) if len(at) else [0]
        for a, b in zip(first, first[1:]):
            for i in mt.matching_rows(patterns[a], _engine_pattern(patterns[a]), s, rows, row[at[a:b]].tolist()):
                found[i].append(int(no[at[a]]))
        out += found
    return pa.array(out, pa.list_(pa.int64()))


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` written, with a number for each row."""
    return written(df.withColumn(column, F.monotonically_increasing_id()), name)


def enabled_rules(rules: DataFrame) -> DataFrame:
    """The rules that can match, numbered by ``_no``."""
    cols = ["rule_id", "layer", "grp", "category", "ord", "anchors", "pattern"]
    return numbered(rules.where(F.col("enabled") & F.col("pattern").isNotNull()).select(*cols), "_no", "rules")


def _anchors(rules: DataFrame) -> DataFrame:
    """(rule, key) of every anchor; a rule without anchors has an empty one."""
    some = F.filter("anchors", lambda a: a != "")
    own = F.when(F.size(some) > 0, F.array_distinct(some)).otherwise(F.array(F.lit("")))
    listed = rules.select("_no", "pattern", F.explode(own).alias("anchor")).withColumn("_k", _keyed(F.col("anchor")))
    return listed.select(F.struct(F.col("_no").alias("no"), F.col("_k.anchor").alias("anchor"), "pattern").alias("rule"), F.col("_k.key").alias("key"))


def _asked(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """(_row, _no) of the texts that match rules of their lists."""
    told = texts.join(lists, "_row").select("_row", _matching(F.col("_text"), F.col("rules")).alias("_nos"))
    return told.select("_row", F.explode("_nos").alias("_no"))


def matches(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(_row, _no) of all matches of ``rules`` (``enabled_rules``) in ``texts``
    (_row, _text), each once."""
    anchors = written(_anchors(rules), "rule-anchors")
    keyed = anchors.where("key <> ''").withColumn("begin", F.substring("key", 1, KEY_CHARS))
    lengths = sorted(r[0] for r in keyed.select(F.length("begin")).distinct().collect())  # KEY_CHARS at most
    held = written(texts.select("_row", F.explode(_tokens(F.col("_text"))).alias("token")), "text-tokens")

    def pieces(at: Column) -> Column:
        return F.array_compact(F.array(*[F.when(F.length("token") >= at + (n - 1), F.substring(F.col("token"), at, F.lit(n))) for n in lengths]))

    found = None
    if lengths:
        places = held.select("token").distinct().select("token", F.explode(F.sequence(F.lit(1), F.length("token"))).alias("at"))
        met = places.select("token", F.explode(pieces(F.col("at"))).alias("begin")).distinct().join(keyed, "begin").where(F.contains("token", "key"))
        place = F.row_number().over(Window.partitionBy("token").orderBy("rule.no"))
        lists = met.select("token", "rule", F.floor((place - 1) / LIST_RULES).alias("part")).groupBy("token", "part").agg(F.collect_list("rule").alias("rules"))
        own = held.join(lists, "token").groupBy("_row", "part").agg(F.flatten(F.collect_list("rules")).alias("rules"))
        found = _asked(texts, own)
    always = anchors.where("key = ''")
    if found is None or not always.isEmpty():
        lists = always.groupBy(F.floor(F.col("rule.no") / LIST_RULES).alias("part")).agg(F.collect_list("rule").alias("rules"))
        everywhere = texts.crossJoin(lists).select("_row", F.explode(_matching(F.col("_text"), F.col("rules"))).alias("_no"))
        found = everywhere if found is None else found.unionByName(everywhere)
    return found.distinct()


def with_hits(df: DataFrame, text_col: str, rules: DataFrame, layers: tuple[str, ...]) -> DataFrame:
    """``df`` (written on the way) with ``_<layer>_hits`` for every layer: the
    matching rules as ``matching.rule_hits`` tells them, in the order of ``ord``."""
    df, rules = numbered(df, "_row", "before-rules"), enabled_rules(rules)
    hit = F.struct(F.coalesce("ord", F.lit(0)).alias("ord"), "_no", F.struct("rule_id", "pattern", "category", "grp").alias("hit"))
    told = matches(df.select("_row", F.col(text_col).alias("_text")), rules).join(rules.select("_no", "layer", hit.alias("_hit")), "_no")
    own = told.groupBy("_row").agg(*[F.sort_array(F.collect_list(F.when(F.col("layer") == x, F.col("_hit")))).alias(f"_{x}") for x in layers])
    none = F.array().cast(f"array<{mt.HIT_TYPE}>")
    return df.join(own, "_row", "left").withColumns({
        f"_{x[:2]}_hits": F.coalesce(F.transform(F.col(f"_{x}"), lambda h: h["hit"]), none) for x in layers}).drop("_row", *[f"_{x}" for x in layers])
