"""Threat-log and retraining-set storage.

Reading accepts every historic generation of the log: blank and malformed
lines are dropped (or kept in ``_corrupt_record`` for a quarantine table),
missing fields are NULL, and ``pipeline_steps`` — whose shape changed between
versions — is read as VARIANT and probed with ``try_variant_get``.
Writing appends JSON lines (non-ASCII kept) or parquet partitioned by day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

LOG_SCHEMA = (
    "id STRING, timestamp STRING, raw STRING, normalized_text STRING, decision STRING, "
    "status STRING, risk STRING, score INT, is_blocked BOOLEAN, is_flagged BOOLEAN, "
    "matched_pattern STRING, all_matched_patterns ARRAY<STRING>, reason STRING, "
    "ai_confidence DOUBLE, ai_prediction INT, vector STRING, decision_source STRING, "
    "lang_dist MAP<STRING, DOUBLE>, pipeline_steps VARIANT"
)
RETRAIN_SCHEMA = (
    "id STRING, text STRING, normalized_text STRING, label INT, score INT, ai_score INT, "
    "ai_confidence DOUBLE, ai_prediction INT, vector STRING, dialect STRING, intent_goal STRING, "
    "notes STRING, saved_at STRING"
)


def utc_timestamp(text: Column) -> Column:
    """A timestamp written as text; one without an offset is UTC, whatever the
    session's time zone.  Unparseable text gives NULL."""
    zoned = F.when(text.rlike(r"(?:[Zz]|UTC|GMT|[+-][0-9]{2}(?::?[0-9]{2})?)$") & text.contains(":"), text).otherwise(
        F.concat(text, F.when(text.contains(":"), "Z").otherwise(" 00:00:00Z")))
    return F.coalesce(F.try_to_timestamp(zoned), F.try_to_timestamp(zoned, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")))


def read_threat_log(spark: SparkSession, path: str, quarantine: bool = False) -> DataFrame:
    """Replay a JSONL threat log.  ``timestamp`` is parsed to TIMESTAMP (a
    value without offset is UTC; unparseable → NULL) and the original string
    kept as ``timestamp_raw``; historic ``pipeline_steps`` keys are lifted."""
    schema = LOG_SCHEMA + (", _corrupt_record STRING" if quarantine else "")
    mode = "PERMISSIVE" if quarantine else "DROPMALFORMED"
    df = spark.read.schema(schema).option("mode", mode).json(path)
    steps = F.col("pipeline_steps")
    lang = F.col("lang_dist")
    return df.withColumns({
        "timestamp_raw": F.col("timestamp"),
        "timestamp": utc_timestamp(F.col("timestamp")),
        "lang_dist": F.struct(*[F.try_element_at(lang, F.lit(a)).alias(a)
                                for a in ("msa", "egyptian", "franco", "english", "unicode", "encoded")]),
        "ai_raw_score": F.try_variant_get(steps, "$.ai_raw_score", "int"),
        "dialect": F.try_variant_get(steps, "$.dialect", "string"),
        "intent_goal": F.try_variant_get(steps, "$.intent_goal", "string"),
        "base_score": F.coalesce(F.try_variant_get(steps, "$.phase_1_normalization.base_score", "int"),
                                 F.try_variant_get(steps, "$.final_score", "int")),
    })


def append_threat_log(log: DataFrame, path: str, fmt: str = "json") -> None:
    """Append verdicts.  JSON keeps one line per verdict; parquet is
    partitioned by day so time-range reads prune partitions."""
    out = log.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    if "lang_dist" in log.columns and dict(log.dtypes)["lang_dist"].startswith("struct"):
        out = out.withColumn("lang_dist", F.from_json(F.to_json("lang_dist"), "map<string,double>"))
    if fmt == "json":
        out.write.mode("append").option("ignoreNullFields", "false").json(path)
    else:
        (out.withColumn("dt", F.to_date(F.col("timestamp").cast("timestamp")))
         .write.mode("append").partitionBy("dt").parquet(path))


def read_retraining(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RETRAIN_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def append_retraining(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back:
    cuts lineage (an executor loss re-reads the table instead of re-screening)
    and keeps filters of later analytics from being pushed into the screening
    projection."""
    return written(df, name)
