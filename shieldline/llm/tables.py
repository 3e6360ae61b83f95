"""Reading inputs and cutting lineage for the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shieldline.session import shared_dir, written

__all__ = ["aside", "documents", "extended", "numbered", "remainder", "restored", "shared_dir", "written"]

_ASIDE = "_aside_"


def aside(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with those of its columns that clash with ``names`` renamed, until
    ``restored`` gives them their names again."""
    return df.withColumnsRenamed({c: _ASIDE + c for c in df.columns if c in names})


def restored(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: c[len(_ASIDE):] for c in df.columns if c.startswith(_ASIDE)})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(column: str, by: int):
    """crc32 of the id as text, modulo ``by``: what the held-out rows go by."""
    return F.crc32(F.col(column).cast("string")) % by


def extended(df: DataFrame, more: str) -> StructType:
    """The schema of ``df`` with more (nullable) columns behind."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the number of each row (from 0) within its group, by ``order``.

    Rows are ranged over all tasks by (group, order), so a group that holds a
    third of all rows is spread; each range is numbered alone and shifted by
    the rows of its group in the ranges before it."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = written(df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most n rows a group
    counts = parts.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_before > 0").drop("_n")
    local = parts.withColumn(name, F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)) - 1)
    a, b = local.alias("a"), counts.alias("b")
    same = F.col("a._part") == F.col("b._part")
    for c in group:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same, "left").select(*[F.col(f"a.{c}") for c in df.columns], (F.col(f"a.{name}") + F.coalesce("b._before", F.lit(0))).alias(name))
