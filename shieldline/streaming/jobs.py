"""Structured Streaming forms of the online service.

The same column functions as the batch jobs run on a ``readStream`` source.
Sinks are files under the session's ``spark.checkpoint.dir`` with a
checkpoint per query, so a restarted query resumes exactly once; aggregate
streams (complete mode) land through ``foreachBatch`` as an idempotent
overwrite of the result table.  ``run_once`` drives a query with
``availableNow`` (process what is there, then stop) — the batch-equivalent
mode used by tests and the query registry; production uses
``trigger(processingTime=...)`` on the same plan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.rules import RulePack
from ..operators import screen as S
from ..session import scratch_path
from ..sources.prompts import prompt_frame

def _st():
    return F.upper(F.coalesce(F.col("status"), F.lit("")))


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    run = scratch_path(spark, f"stream-{name}")
    return f"{run}/data", f"{run}/checkpoint"


def run_once(stream: DataFrame, name: str, mode: str = "append", at: tuple[str, str] | None = None) -> DataFrame:
    """Run ``stream`` over all available input and return its result table.
    ``at`` (data and checkpoint paths) continues an earlier run."""
    spark = stream.sparkSession
    data, ckpt = at or _paths(spark, name)
    w = stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").outputMode("append").start(data)
    else:
        def sink(batch: DataFrame, epoch: int) -> None:
            if mode == "complete":
                batch.write.mode("overwrite").parquet(data)
            else:  # one part per micro-batch: a repeated batch replaces its own
                batch.write.mode("overwrite").parquet(f"{data}/epoch={epoch}")
        q = w.outputMode(mode).foreachBatch(sink).start()
    q.awaitTermination()
    return spark.read.parquet(data)


def read_stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int = 64) -> DataFrame:
    """Stream one table of a directory of parquet tables, be it a file or a
    folder of files.  The file source takes a folder or a pattern, so the table
    is named by a pattern that it alone matches."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .parquet(f"{sf_dir}/{name}.parque[t]"))


def stream_screen(spark: SparkSession, sf_dir: str, pack: RulePack, source: str = "documents",
                  logged_at: str | None = None, max_files: int = 64, tasks: int | None = None, **kw) -> DataFrame:
    """Each arriving prompt is screened and appended to the log.  A micro-batch
    is dealt over ``tasks`` (three a core if not given, 0 to leave it in the
    tasks of its files): it often comes as one file, and screening costs far more
    than moving its text."""
    prompts = prompt_frame(read_stream_table(spark, sf_dir, source, max_files), source)
    tasks = 3 * spark.sparkContext.defaultParallelism if tasks is None else tasks
    if tasks:
        prompts = prompts.repartition(tasks)
    return S.screen_prompts(prompts, pack, logged_at=logged_at, **kw)


def stream_counters(screened_stream: DataFrame) -> DataFrame:
    """Running counters (the service's in-memory ones): per vector the number
    of entries and the sums of their language profile."""
    return screened_stream.groupBy("vector").agg(
        F.count("*").alias("n"), *[F.sum(F.coalesce(F.col(f"lang_dist.{a}"), F.lit(0.0))).alias(f"{a}_sum") for a in fv.LANG_AXES])


def events_log_frame(events: DataFrame) -> DataFrame:
    """Map an events table (batch or stream) onto the log vocabulary:
    error → BLOCKED, signup → FLAGGED, everything else SAFE."""
    status = (F.when(F.col("event_type") == "error", "BLOCKED")
              .when(F.col("event_type") == "signup", "FLAGGED").otherwise("SAFE"))
    score = F.least(F.floor(F.col("value")).cast("int"), F.lit(fv.SCORE_CAP))
    return events.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("props").alias("raw"),
        F.col("props").alias("normalized_text"),
        status.alias("status"),
        F.when(status == "BLOCKED", "BLOCKED").when(status == "FLAGGED", "FLAG").otherwise("SAFE").alias("decision"),
        score.alias("score"), "user_id", "event_type",
        F.lit(fv.VECTOR_NONE).alias("vector"),
        F.lit(None).cast("double").alias("ai_confidence"), F.lit(None).cast("int").alias("ai_prediction"),
    )


def slot_geometry(as_of: str, window_hours: int) -> tuple[dt.datetime, int]:
    start = dt.datetime.fromisoformat(as_of) - dt.timedelta(hours=window_hours)
    return start, max(window_hours * 60 // fv.TIMELINE_SLOTS, 1)


def stream_timeline(events_stream: DataFrame, as_of: str, window_hours: int = 24,
                    lateness: str = "1 hour") -> DataFrame:
    """Tumbling slots aligned to the dashboard's slot grid; counts per slot and
    status class.  Run it in ``append`` or ``update`` mode: a slot's state goes
    when the watermark has passed it (in append mode its row comes out then)."""
    start, slot_min = slot_geometry(as_of, window_hours)
    epoch = int(start.replace(tzinfo=dt.timezone.utc).timestamp())
    offset_s = epoch % (slot_min * 60)
    log = events_log_frame(events_stream).withWatermark("timestamp", lateness)
    w = F.window("timestamp", f"{slot_min} minutes", startTime=f"{offset_s} seconds")
    return (log.groupBy(w.alias("w"))
            .agg(F.count_if(_st() == "BLOCKED").alias("blocked"),
                 F.count_if(_st() == "FLAGGED").alias("flagged"),
                 F.count_if(~_st().isin("BLOCKED", "FLAGGED")).alias("safe")))


def timeline_slots(result: DataFrame, as_of: str, window_hours: int) -> DataFrame:
    start, slot_min = slot_geometry(as_of, window_hours)
    end = start + dt.timedelta(minutes=slot_min * fv.TIMELINE_SLOTS)
    return (result.filter((F.col("w.start") >= F.lit(start)) & (F.col("w.start") < F.lit(end)))
            .select(F.col("w.start").alias("slot_start"), "blocked", "flagged", "safe"))


def stream_dedupe(events_stream: DataFrame, keys: list[str], watermark: str | None = None) -> DataFrame:
    """Drop replays.  With a watermark, state is bounded
    (``dropDuplicatesWithinWatermark``): a replay within it is dropped.  Without,
    dedupe is exact over the whole stream, and so is its state."""
    if watermark:
        return events_stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)
    return events_stream.dropDuplicates(keys)
