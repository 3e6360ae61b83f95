"""Corpus censuses over normalised prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import words
from ..sources.rules_source import keywords_source

def keyword_frequency(normalized: DataFrame, spark: SparkSession,
                      keywords: DataFrame | None = None) -> DataFrame:
    """Occurrences of each dangerous keyword across the corpus: explode the
    words, semi-join the keyword table, count.  Words are pre-aggregated per
    partition by the hash aggregate before the shuffle, so a keyword that
    dominates the corpus never concentrates raw rows in one task."""
    kw = (keywords if keywords is not None else keywords_source(spark)).select(F.col("word").alias("keyword"))
    exploded = (normalized.select(F.explode_outer(words(F.col("normalized_text"))).alias("keyword"))
                .filter(F.col("keyword").isNotNull()))
    return (exploded.join(kw, "keyword", "left_semi")
            .groupBy("keyword").agg(F.count("*").alias("occurrences")))
