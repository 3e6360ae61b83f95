"""Running state of the service: its newest entries, counters, late rows.

Sinks write what a micro-batch changed under the batch's own number, so a batch
that is repeated after a crash replaces its own output, and a table is never
rewritten whole.  Readers take the newest version of each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import fixed_values as fv
from ..operators.browse import retain_latest

#: Groups that the newest entries are kept in.
SHARDS = 16
_ENTRY = "id string, timestamp timestamp, status string, entry string"


def _newest(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """The first ``n`` rows, newest first; without a time last; equal times by id."""
    return rows.sort_values(["timestamp", "id"], ascending=[False, True], na_position="last", kind="stable").head(n)


def stream_latest(log_stream: DataFrame, n: int = fv.RETAIN_ENTRIES, shards: int = SHARDS) -> DataFrame:
    """The newest ``n`` entries of each shard, told anew whenever a shard has got
    rows: (shard, id, timestamp, status, entry), entry being the row as JSON.

    The state is bounded: ``n`` entries a shard, whatever has passed.  A late row
    is placed by its time like any other, so there is no watermark to miss."""
    kept = log_stream.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"),
                             "id", F.col("timestamp").cast("timestamp").alias("timestamp"), "status", F.to_json(F.struct("*")).alias("entry"))
    names = ["id", "timestamp", "status", "entry"]

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(dict(zip(names, state.get))).astype({"timestamp": "datetime64[ns]"}) if state.exists else None
        for f in frames:
            held = _newest(f[names] if held is None else pd.concat([held, f[names]]), n)
        stamps = [None if pd.isna(t) else t.to_pydatetime() for t in held["timestamp"]]
        state.update((held["id"].tolist(), stamps, held["status"].tolist(), held["entry"].tolist()))
        yield held.assign(shard=key[0])[["shard", *names]]

    return kept.groupBy("shard").applyInPandasWithState(
        keep, f"shard int, {_ENTRY}", "id array<string>, timestamp array<timestamp>, status array<string>, entry array<string>",
        "update", GroupStateTimeout.NoTimeout)


def latest_of(told: DataFrame, n: int = fv.RETAIN_ENTRIES) -> DataFrame:
    """The newest ``n`` entries of all shards, from the last version of each
    (``told`` has the batch's number as ``epoch``)."""
    last = told.groupBy("shard").agg(F.max("epoch").alias("epoch"))
    return retain_latest(told.join(last, ["shard", "epoch"]).drop("shard", "epoch"), n)


def newest_version(told: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, that of the last batch which changed it."""
    rest = [c for c in told.columns if c not in (*keys, "epoch")]
    return told.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_x")).select(*keys, "_x.*")


# the timeline with its late rows


def _epochs(spark, path: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) else None


def append_slots(log_stream: DataFrame, path: str, checkpoint: str, slot: str, lateness: str, **trigger) -> StreamingQuery:
    """Starts counting the entries of each slot of time (such as ``72 minutes``)
    and status class.  A micro-batch adds its own counts; it never changes those of others.

    A row is late if its slot had ended ``lateness`` before the newest time of the
    batches before: it is not counted but kept, whole, so that nothing is lost
    without a trace and the counts with the late rows equal those of a batch job.
    Rows without a time are late."""
    spark = log_stream.sparkSession

    def sink(batch: DataFrame, epoch: int) -> None:
        stamped = batch.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        untimed = stamped.where("timestamp is null").withColumn("slot", F.lit(None).cast("struct<start:timestamp,end:timestamp>"))
        timed = stamped.withColumn("slot", F.window("timestamp", slot)).unionByName(untimed)  # a window leaves rows without a time out
        newest = _epochs(spark, f"{path}/newest")
        passed = None if newest is None else newest.where(F.col("epoch") < epoch).agg(
            (F.max("newest") - F.expr(f"INTERVAL {lateness}")).alias("w")).first().w
        late = F.col("slot").isNull() | (F.lit(False) if passed is None else F.col("slot.end") <= F.lit(passed))
        st = F.upper(F.coalesce(F.col("status"), F.lit("")))
        counts = timed.where(~late).groupBy("slot").agg(
            F.count_if(st == "BLOCKED").alias("blocked"), F.count_if(st == "FLAGGED").alias("flagged"), F.count_if(~st.isin("BLOCKED", "FLAGGED")).alias("safe"))
        counts.select(F.col("slot.start").alias("slot_start"), "blocked", "flagged", "safe").write.mode("overwrite").parquet(f"{path}/slots/epoch={epoch}")
        timed.where(late).drop("slot").write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")
        stamped.agg(F.max("timestamp").alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/epoch={epoch}")

    return log_stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(sink).start()


def slots(spark, path: str) -> DataFrame:
    """slot_start, blocked, flagged, safe over all batches."""
    added = [F.sum(c).alias(c) for c in ("blocked", "flagged", "safe")]
    return spark.read.parquet(f"{path}/slots").groupBy("slot_start").agg(*added)


def late_rows(spark, path: str) -> DataFrame:
    """The rows that came too late, with the batch that brought them as ``epoch``."""
    return spark.read.parquet(f"{path}/late")
