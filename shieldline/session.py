"""Session construction for tests, the bench and local runs, and the folder
that driver and executors share.

On a cluster the session comes from the platform, and the shared folder is what
``spark.checkpoint.dir`` names; without it a job that has to write there stops.
Only a session of one JVM (master ``local``), where driver and executors share
their disk, gets a folder of its own.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "shieldline") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SHIELDLINE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="shieldline-")
    return _own[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder, which is
    deleted when the application ends."""
    context = spark.sparkContext
    root = f"{shared_dir(spark)}/shieldline-{context.applicationId}"
    if root not in _made:
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)
        _made.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: what
    follows survives the loss of any executor without computing ``df`` anew."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
