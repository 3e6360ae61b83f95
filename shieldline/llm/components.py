"""Connected components of a graph that is never collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shieldline.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the links (a, b): component is the least
    id that is reachable.  Large-star and small-star rounds: each hangs
    neighbours on the least one they know, until all hang on their root; the
    number of rounds is logarithmic in practice.  Each round is written, so a
    lost executor costs one round at most.  Loops and nulls are left out."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: greater neighbours of u hang on the least of u and its neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        # small star: u and its lesser neighbours hang on the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        hang = least.select("u", F.col("m").alias("v"))
        edges = written(small.unionByName(hang).distinct(), "small-star")
        if (after := _state(edges)) == state:
            break
        state = after
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots).distinct()


def _state(edges: DataFrame) -> tuple:
    """What tells two sets of links apart: their number and sums of hashes."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return r.n, r.h


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (id, component) after more links (a, b): only the components
    that the links touch are looked at."""
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    known = written(roots.unionByName(ends.join(roots, "id", "left_anti").select("id", F.col("id").alias("component"))), "roots")
    a, b = (known.toDF(x, f"c{x}") for x in "ab")
    lifted = links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    merged = components(lifted).toDF("component", "least")
    return written(known.join(merged, "component", "left").select("id", F.coalesce("least", "component").alias("component")), "roots")
