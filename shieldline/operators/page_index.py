"""Pages by number from an index beside the log.

``build_page_index`` writes the (filtered) log once in the order of its pages,
in ranges of about ``RANGE_ROWS`` rows, each row with its place in its range, and
the ranges' sizes.  ``indexed_page`` then reads the few ranges that hold a page,
by partition and by place: nothing is shuffled or counted for a page.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .browse import log_filter, newest_first

RANGE_ROWS = 200_000


def build_page_index(log: DataFrame, path: str, status: str | None = None, range_rows: int = RANGE_ROWS) -> str:
    """Writes the index of the pages of ``log`` under a status filter."""
    own = log_filter(log, status)
    n = max(1, math.ceil(own.count() / range_rows))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = own.repartitionByRange(n, *newest_first()).sortWithinPartitions(*newest_first())
    ranged.withColumns({"_range": F.spark_partition_id(), "_place": place}).write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    spark = log.sparkSession
    sizes = spark.read.parquet(f"{path}/rows").groupBy("_range").agg(F.count("*").alias("n"))
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")
    return path


def indexed_page(spark: SparkSession, path: str, page: int = 1, page_size: int = fv.PAGE_SIZE_DEFAULT) -> DataFrame:
    """The page with ``rank``, its rows' place in the whole order (from 1)."""
    if page < 1 or not 1 <= page_size <= fv.PAGE_SIZE_MAX:
        raise ValueError("page >= 1 and 1 <= page_size <= 200")
    low, high = (page - 1) * page_size, page * page_size
    start, wanted = 0, {}
    for r in spark.read.parquet(f"{path}/sizes").orderBy("_range").toLocalIterator():
        if start < high and start + r.n > low:
            wanted[r["_range"]] = start
        start += r.n
    rows = spark.read.parquet(f"{path}/rows")
    if not wanted:
        return rows.limit(0).withColumn("rank", F.lit(0)).drop("_range", "_place")
    held = None
    for number, before in wanted.items():
        own = rows.where((F.col("_range") == number) & (F.col("_place") >= low - before) & (F.col("_place") < high - before))
        own = own.withColumn("rank", (F.col("_place") + before + 1).cast("int"))
        held = own if held is None else held.unionByName(own)
    return held.drop("_range", "_place")


def index_total(spark: SparkSession, path: str, page_size: int = fv.PAGE_SIZE_DEFAULT) -> DataFrame:
    """``total`` and ``pages`` of the index, from the ranges' sizes alone."""
    total = F.coalesce(F.sum("n"), F.lit(0)).alias("total")
    return spark.read.parquet(f"{path}/sizes").agg(total).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("long"))
