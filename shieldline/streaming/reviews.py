"""Reviews applied while the log grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators.review import MESSAGES


def stream_reviews(log_stream: DataFrame, reviews_stream: DataFrame, lateness: str = "1 hour", max_age: str = "30 days") -> DataFrame:
    """Every valid review with ``status``: ``recorded`` as soon as the log holds
    its entry, whichever of the two comes first; ``not_found`` when the watermark
    of the log says that the entry can no longer come.

    An entry is reviewed within ``max_age`` of its time (before or after, as
    clocks differ), which bounds the state: entries and reviews of that age go."""
    entries = log_stream.select(F.col("id").alias("_id"), F.col("timestamp").cast("timestamp").alias("_at")).withWatermark("_at", lateness)
    valid = reviews_stream.filter(F.col("action").isin(*fv.REVIEW_ACTIONS)).withWatermark("reviewed_at", lateness)
    near = F.expr(f"_id = item_id AND _at >= reviewed_at - INTERVAL {max_age} AND _at <= reviewed_at + INTERVAL {max_age}")
    return valid.join(entries, near, "leftOuter").select(
        "item_id", "action", "notes", "reviewer_id", "reviewed_at", F.when(F.col("_id").isNull(), "not_found").otherwise("recorded").alias("status"))


def recorded_reviews(told: DataFrame) -> DataFrame:
    """The latest recorded review of each item with its message, as
    ``operators.review.review_apply`` tells it."""
    msg = F.create_map(*[x for k, v in MESSAGES.items() for x in (F.lit(k), F.lit(v))])
    best = told.where("status = 'recorded'").groupBy("item_id").agg(F.max(F.struct("reviewed_at", "reviewer_id", "action", "notes")).alias("r"))
    return best.select("item_id", "r.action", "r.reviewer_id", "r.reviewed_at", F.lit("recorded").alias("status"),
                       F.coalesce(F.try_element_at(msg, F.col("r.action")), F.lit("Decision recorded.")).alias("message"))
