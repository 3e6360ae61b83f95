"""Dashboard aggregates over a threat log (any DataFrame with the log
columns).  All are hash aggregates with map-side partial aggregation, so a
status or vector holding a third of the log is pre-aggregated per task before
the shuffle; no group is ever collected."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.enrich import vector_color


def _st():
    return F.upper(F.coalesce(F.col("status"), F.lit("")))


def status_counts(log: DataFrame) -> DataFrame:
    """Total plus per-status counts (case-insensitive; a missing status
    counts nowhere)."""
    return log.agg(
        F.count("*").alias("total"),
        F.count_if(_st() == "BLOCKED").alias("blocked"),
        F.count_if(_st() == "FLAGGED").alias("flagged"),
        F.count_if(_st() == "SAFE").alias("safe"),
    )


def threat_rate(log: DataFrame) -> DataFrame:
    """round((blocked + flagged) / total * 100, 1), 0 for an empty log;
    rounding is half-even like Python's ``round``."""
    c = status_counts(log)
    rate = F.when(F.col("total") > 0,
                  F.bround((F.col("blocked") + F.col("flagged")) / F.col("total") * 100, 1)).otherwise(F.lit(0.0))
    return c.select("total", "blocked", "flagged", rate.cast("double").alias("threat_rate"))


def language_distribution(log: DataFrame) -> DataFrame:
    """Mean of each language axis over all entries (missing profile = 0),
    one row per axis in fixed order."""
    aggs = [
        F.sum(F.coalesce(F.col(f"lang_dist.{a}"), F.lit(0.0))).alias(a) for a in fv.LANG_AXES
    ] + [F.count("*").alias("_n")]
    sums = log.agg(*aggs)
    stack = "stack({n}, {items}) as (ord, subject, total)".format(
        n=len(fv.LANG_AXES),
        items=", ".join(f"{i}, '{fv.LANG_LABELS[a]}', `{a}`" for i, a in enumerate(fv.LANG_AXES)),
    )
    return sums.selectExpr("_n", stack).select(
        "ord", "subject",
        F.when(F.col("_n") > 0, F.bround(F.col("total") / F.col("_n"), 1)).otherwise(F.lit(0.0))
        .cast("double").alias("value"),
    )


def attack_breakdown(log: DataFrame) -> DataFrame:
    """Count per attack vector (excluding "None"), in no order (see
    ``ranked_breakdown``).  Colour from a literal map (the vector vocabulary is
    fixed)."""
    agg = (log.filter(F.coalesce(F.col("vector"), F.lit(fv.VECTOR_NONE)) != fv.VECTOR_NONE)
           .groupBy(F.col("vector").alias("name"))
           .agg(F.count("*").alias("count"), F.min("timestamp").alias("first_seen")))
    return agg.select("name", "count", vector_color(F.col("name")).alias("color"), "first_seen")


def ranked_breakdown(log: DataFrame) -> DataFrame:
    b = attack_breakdown(log)
    return b.orderBy(F.col("count").desc(), F.col("first_seen").asc(), F.col("name").asc())


def top_vector(log: DataFrame) -> DataFrame:
    top = ranked_breakdown(log).limit(1).select("name")
    # An empty breakdown yields "None": aggregate the (0..1-row) top-1 frame.
    return top.agg(F.coalesce(F.first("name"), F.lit(fv.VECTOR_NONE)).alias("top_vector"))


def _clock(at: Column) -> Column:
    """HH:mm of a time in UTC."""
    minute = F.floor(F.unix_micros(at) / 60_000_000) % 1440
    return F.format_string("%02d:%02d", F.floor(minute / 60), minute % 60)


def utc(text: str) -> Column:
    """A literal time that is UTC whatever the session's time zone."""
    return F.timestamp_micros(F.lit(int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)))


def timeline(spark: SparkSession, log: DataFrame, as_of: str, window_hours: int = 24) -> DataFrame:
    """Ten half-open slots of max(W*60//10, 1) minutes ending at ``as_of``;
    per slot the BLOCKED / FLAGGED / other counts.  Empty slots come from a
    10-row spine (a left join, not a cross product)."""
    if not 1 <= window_hours <= 720:
        raise ValueError("window_hours must be in 1..720")
    slot_min = max(window_hours * 60 // fv.TIMELINE_SLOTS, 1)
    start = utc(as_of) - F.expr(f"INTERVAL {window_hours} HOURS")
    secs = (F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(start)) / 1_000_000
    slot = F.floor(secs / (slot_min * 60)).cast("int")
    counted = (log.filter(F.col("timestamp").isNotNull())
               .withColumn("slot", slot)
               .filter((F.col("slot") >= 0) & (F.col("slot") < fv.TIMELINE_SLOTS))
               .groupBy("slot")
               .agg(F.count_if(_st() == "BLOCKED").alias("blocked"),
                    F.count_if(_st() == "FLAGGED").alias("flagged"),
                    F.count_if(~_st().isin("BLOCKED", "FLAGGED")).alias("safe")))
    spine = spark.range(fv.TIMELINE_SLOTS).select(F.col("id").cast("int").alias("slot"))
    slot_start = start + F.make_interval(mins=F.col("slot") * slot_min)
    return (spine.join(F.broadcast(counted), "slot", "left")
            .select("slot", _clock(slot_start).alias("time"),
                    *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("blocked", "flagged", "safe")]))


def dashboard_summary(log: DataFrame, as_of: str | None = None, window_hours: int = 24) -> DataFrame:
    """The summary card row: totals, threat rate, the constant model accuracy
    the service reports, the top vector, and the three nested lists:
    language_dist (fixed order), attack_breakdown (busiest first; ties: first
    seen, then name) and timeline (ten slots that end at ``as_of``, by default
    the time of the newest entry).

    Two aggregation levels and no join: partial counts per vector and timeline
    slot first (map-side combined), then one global row.  The lists hold at most
    the fixed vectors, axes and slots."""
    status = _st()
    slots, slot_min = fv.TIMELINE_SLOTS, max(window_hours * 60 // fv.TIMELINE_SLOTS, 1)
    if as_of is None:
        newest = log.agg(F.max("timestamp").alias("t")).first().t
        end = F.lit(newest).cast("timestamp")
    else:
        end = utc(as_of)
    start = end - F.expr(f"INTERVAL {window_hours} HOURS")
    at = F.floor((F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(start)) / (slot_min * 60_000_000)).cast("int")
    slot = F.when((at >= 0) & (at < slots), at)
    axes = [F.sum(F.coalesce(F.col(f"lang_dist.{a}"), F.lit(0.0))).alias(f"l_{a}") for a in fv.LANG_AXES] if "lang_dist" in log.columns else []
    per = log.groupBy(F.coalesce(F.col("vector"), F.lit(fv.VECTOR_NONE)).alias("name"), slot.alias("slot")).agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first_seen"),
        F.count_if(status == "BLOCKED").alias("b"), F.count_if(status == "FLAGGED").alias("f"),
        F.count_if(status == "SAFE").alias("s"), *axes)
    vector = F.struct("name", "n", "first_seen")
    tot = per.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(a) for a, c in (
            ("total_requests", "n"), ("total_blocked", "b"), ("total_flagged", "f"), ("total_safe", "s"))],
        F.collect_list(F.when(F.col("name") != fv.VECTOR_NONE, vector)).alias("parts"),  # vectors times slots at most
        *[F.sum(F.when(F.col("slot") == i, F.col(c))).alias(f"{c}{i}") for i in range(slots) for c in "bfn"],
        *[F.sum(f"l_{a}").alias(f"l_{a}") for a in fv.LANG_AXES if axes])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    n = F.col("total_requests")
    rate = F.when(n > 0, F.bround((F.col("total_blocked") + F.col("total_flagged")) / n * 100, 1)).otherwise(F.lit(0.0))
    mean = lambda a: (F.when(n > 0, F.bround(F.col(f"l_{a}") / n, 1)).otherwise(F.lit(0.0)) if axes else F.lit(0.0)).cast("double")
    names = F.array_distinct(F.transform("parts", lambda p: p["name"]))

    def entry(name: Column) -> Column:
        own = F.filter("parts", lambda p: p["name"] == name)
        total = F.aggregate(own, F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
        return F.struct((-total).alias("order"), F.array_min(F.transform(own, lambda p: p["first_seen"])).alias("seen"), name.alias("name"), total.alias("count"))

    ranked = F.array_sort(F.transform(names, entry))
    breakdown = F.transform(ranked, lambda e: F.struct(e["name"].alias("name"), e["count"].alias("count"), vector_color(e["name"]).alias("color")))
    line = F.array(*[F.struct(
        _clock(start + F.expr(f"INTERVAL {i * slot_min} MINUTES")).alias("time"), zero(F.col(f"b{i}")).alias("blocked"), zero(F.col(f"f{i}")).alias("flagged"),
        (zero(F.col(f"n{i}")) - zero(F.col(f"b{i}")) - zero(F.col(f"f{i}"))).alias("safe")) for i in range(slots)])
    return tot.select(
        "total_requests", "total_blocked", "total_flagged", "total_safe",
        rate.cast("double").alias("threat_rate"), F.lit(fv.MODEL_ACCURACY_CONSTANT).alias("ai_accuracy"),
        F.coalesce(F.get(ranked, F.lit(0))["name"], F.lit(fv.VECTOR_NONE)).alias("top_vector"),
        F.array(*[F.struct(F.lit(fv.LANG_LABELS[a]).alias("subject"), mean(a).alias("value")) for a in fv.LANG_AXES]).alias("language_dist"),
        breakdown.alias("attack_breakdown"), line.alias("timeline"))
