"""Rule packs as DataFrames.

``rules_source(spark)`` returns the built-in pack; ``read_rules(spark, path)``
reads a user pack (JSON lines or CSV with the same columns) so rules can be
extended without code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from . import default_rules

RULES_SCHEMA = (
    "rule_id string, layer string, grp string, category string, ord int, "
    "anchors array<string>, pattern string, enabled boolean"
)


def default_rule_rows() -> list[tuple]:
    rows = []
    for layer, pack, labels, prefix in (
        ("arabic", default_rules.ARABIC, fv.ARABIC_GROUP_LABELS, "ar"),
        ("english", default_rules.ENGLISH, fv.ENGLISH_GROUP_LABELS, "en"),
    ):
        for i, (grp, anchors, pattern) in enumerate(pack, start=1):
            rows.append((f"{prefix}-{i:03d}", layer, grp, labels.get(grp, fv.CATEGORY_UNKNOWN),
                         i, list(anchors), pattern, True))
    return rows


def rules_source(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(default_rule_rows(), RULES_SCHEMA)


def read_rules(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    if fmt == "json":
        df = spark.read.schema(RULES_SCHEMA).json(path)
    else:  # anchors are one field, separated by "|"
        flat = RULES_SCHEMA.replace("array<string>", "string")
        df = spark.read.schema(flat).option("header", True).option("escape", '"').csv(path)
        df = df.withColumn("anchors", F.array_remove(F.split(F.coalesce("anchors", F.lit("")), r"\|"), ""))
    return df.withColumn("enabled", F.coalesce("enabled", F.lit(True))).select("rule_id", "layer", "grp", "category", "ord", "anchors", "pattern", "enabled")


def keywords_source(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in fv.DANGEROUS_KEYWORDS], "word string")
