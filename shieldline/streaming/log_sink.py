"""A threat log that a stream appends to: Parquet by day, exactly once.

Each micro-batch is a folder ``part=e<number>`` with a folder for each day; a
batch that is repeated after a crash replaces its own.  ``compact`` merges the
batches up to a number into ``part=m<number>`` with few files a day.  A reader
takes the last complete merge and the complete batches behind it, so neither a
half-written batch nor a crash while merging shows, and filters on ``dt`` read
the folders of those days only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_PART = re.compile(r"part=([em])(\d+)$")


def append_stream(log_stream: DataFrame, path: str, checkpoint: str, day_of: str = "timestamp", **trigger) -> StreamingQuery:
    """Starts appending.  Rows without a time are of the day null."""
    def sink(batch: DataFrame, epoch: int) -> None:
        dated = batch.withColumn("dt", F.to_date(F.col(day_of).cast("timestamp")))
        dated.write.mode("overwrite").partitionBy("dt").parquet(f"{path}/part=e{epoch:012d}")

    return log_stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(sink).start()


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def parts(spark: SparkSession, path: str) -> list[tuple[str, int, str]]:
    """(kind, number, path) of the complete parts that make up the log."""
    folder, system = _folder(spark, path)
    if not system.exists(folder):
        return []
    found = []
    for status in system.listStatus(folder):
        own = status.getPath()
        if (m := _PART.search(own.getName())) and system.exists(spark._jvm.org.apache.hadoop.fs.Path(own, "_SUCCESS")):
            found.append((m[1], int(m[2]), own.toString()))
    merged = max((n for kind, n, _ in found if kind == "m"), default=-1)
    return sorted(x for x in found if x[0] == "m" and x[1] == merged or x[0] == "e" and x[1] > merged)


def read_log(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The log with its day as ``dt``.  ``schema`` (with dt) is for a log that
    has no part yet, and saves looking into the files of one that has."""
    own = [p for _, _, p in parts(spark, path)]
    if not own:
        if schema is None:
            raise FileNotFoundError(f"no complete part under {path}")
        return spark.createDataFrame([], schema)
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).parquet(*own).drop("part")


def compact(spark: SparkSession, path: str, files_per_day: int = 1) -> int:
    """Merges all complete parts; returns the number of the last batch in the
    merge (-1: there was nothing).  The parts it replaces are deleted at last."""
    own = parts(spark, path)
    if not own:
        return -1
    upto = max(n for _, n, _ in own)
    if [k for k, _, _ in own] == ["m"]:
        return upto
    salt = F.pmod(F.xxhash64("id"), F.lit(files_per_day)) if files_per_day > 1 else F.lit(0)
    read_log(spark, path).repartition("dt", salt).write.mode("overwrite").partitionBy("dt").parquet(f"{path}/part=m{upto:012d}")
    _, system = _folder(spark, path)
    for _, _, old in own:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)
    return upto
