"""Log browsing: status / date filters, newest-first paging, id lookup, the
review queue projection and the bounded "latest" views.

Pages are asked for by number or behind a known entry.  Behind an entry
(``page_after``) a page is a top-k of ``page_size`` rows.  By number, the log is
dealt into ranges of the order, each range's rows are counted, and only the
ranges that hold the page are numbered: no task holds more than a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.enrich import risk_band
from ..session import written
from .analytics import utc

#: Rows up to which a page by number is a top-k.
FIRST_ROWS = 1_000
VALID_FILTERS = ("ALL", "BLOCKED", "FLAGGED", "SAFE")


def newest_first():
    return [F.col("timestamp").desc_nulls_last(), F.col("id").asc()]


def log_filter(log: DataFrame, status: str | None) -> DataFrame:
    """``None``/``ALL`` keeps everything; any other value filters
    case-insensitively (an unknown value yields an empty result)."""
    if status is None or status.upper() == "ALL":
        return log
    return log.filter(F.upper(F.coalesce(F.col("status"), F.lit(""))) == status.upper())


def log_date_range(log: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Inclusive bounds, UTC, compared as TIMESTAMPs (the service compared ISO
    strings; a timestamp compare is the intended meaning)."""
    if date_from:
        log = log.filter(F.col("timestamp") >= utc(date_from))
    if date_to:
        log = log.filter(F.col("timestamp") <= utc(date_to))
    return log


def page_of(log: DataFrame, page: int = 1, page_size: int = fv.PAGE_SIZE_DEFAULT) -> DataFrame:
    if page < 1 or not 1 <= page_size <= fv.PAGE_SIZE_MAX:
        raise ValueError("page >= 1 and 1 <= page_size <= 200")
    low, high = (page - 1) * page_size, page * page_size
    w = Window.orderBy(*newest_first())
    if high <= FIRST_ROWS:  # the first pages: a bounded top-k
        top = log.orderBy(*newest_first()).limit(high)
        return top.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") > low)
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = written(log.repartitionByRange(n, *newest_first()).withColumn("_range", F.spark_partition_id()), "log-ranges")
    start, wanted = 0, {}
    for r in ranges.groupBy("_range").count().orderBy("_range").collect():  # n rows at most
        if start < high and start + r["count"] > low:
            wanted[r["_range"]] = start
        start += r["count"]
    if not wanted:
        return log.limit(0).withColumn("rank", F.lit(0))
    before = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*newest_first()))
    held = ranges.filter(F.col("_range").isin(list(wanted))).withColumn("rank", (local + before[F.col("_range")]).cast("int"))
    return held.filter((F.col("rank") > low) & (F.col("rank") <= high)).drop("_range")


def page_after(log: DataFrame, timestamp, entry_id: str | None, page_size: int = fv.PAGE_SIZE_DEFAULT) -> DataFrame:
    """The page behind a known entry: the next ``page_size`` rows, newest first."""
    at, i = F.lit(timestamp), F.lit(entry_id)
    behind = (F.col("timestamp") < at) | F.col("timestamp").isNull() | ((F.col("timestamp") == at) & (F.col("id") > i))
    return log.filter(behind).orderBy(*newest_first()).limit(page_size)


def log_page(log: DataFrame, page: int = 1, page_size: int = fv.PAGE_SIZE_DEFAULT,
             status: str | None = None, date_from: str | None = None,
             date_to: str | None = None) -> DataFrame:
    """One page of the filtered log, newest first (``rank`` is the position
    in the filtered order)."""
    return page_of(log_date_range(log_filter(log, status), date_from, date_to), page, page_size)


def log_page_meta(log: DataFrame, page_size: int = fv.PAGE_SIZE_DEFAULT, status: str | None = None,
                  date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """``total`` and ``pages`` (at least 1) of the same filtered log."""
    filtered = log_date_range(log_filter(log, status), date_from, date_to)
    return filtered.agg(F.count("*").alias("total")).withColumn(
        "pages", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(page_size))).cast("long"))


def log_lookup(log: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries whose id is in ``ids`` (column ``id``): a semi join, so a
    lookup of many ids is one shuffle (or a broadcast when ``ids`` is small)."""
    return log.join(ids.select("id").distinct(), "id", "left_semi")


def _field(log: DataFrame, name: str, dtype: str):
    """A log field, or NULL when this log generation lacks it."""
    return F.col(name) if name in log.columns else F.lit(None).cast(dtype)


def queue_view(log: DataFrame) -> DataFrame:
    """Review-queue projection: rows without id or timestamp are skipped,
    missing status reads SAFE, a missing risk is recomputed from the score."""
    score = F.coalesce(_field(log, "score", "int"), F.lit(0))
    return (log.filter(F.col("id").isNotNull() & F.col("timestamp").isNotNull())
            .select("id", F.coalesce(_field(log, "raw", "string"), F.lit("")).alias("text"),
                    F.coalesce(_field(log, "normalized_text", "string"), F.lit("")).alias("normalized"),
                    score.alias("score"),
                    F.coalesce(_field(log, "risk", "string"), risk_band(score)).alias("risk"),
                    F.coalesce(_field(log, "status", "string"), F.lit("SAFE")).alias("status"),
                    F.coalesce(_field(log, "vector", "string"), F.lit(fv.VECTOR_NONE)).alias("vector"),
                    _field(log, "ai_confidence", "double").alias("ai_confidence"),
                    _field(log, "ai_prediction", "int").alias("ai_prediction"), "timestamp"))


def queue_page(log: DataFrame, status: str = "ALL", page: int = 1,
               page_size: int = fv.PAGE_SIZE_DEFAULT) -> DataFrame:
    """An unknown filter means ALL (unlike the log browser)."""
    f = status.upper() if status and status.upper() in VALID_FILTERS else "ALL"
    return page_of(_queue(log, f), page, page_size).withColumn("filter_applied", F.lit(f))


def _queue(log: DataFrame, f: str) -> DataFrame:
    view = queue_view(log)
    return view if f == "ALL" else view.filter(F.upper(F.col("status")) == f)


def queue_total(log: DataFrame, status: str = "ALL") -> DataFrame:
    """``total`` entries of the filtered queue, beside its pages."""
    f = status.upper() if status and status.upper() in VALID_FILTERS else "ALL"
    return _queue(log, f).agg(F.count("*").alias("total")).withColumn("filter_applied", F.lit(f))


def retain_latest(log: DataFrame, n: int = fv.RETAIN_ENTRIES) -> DataFrame:
    """The rolling window of the newest ``n`` entries (top-k, bounded)."""
    return log.orderBy(*newest_first()).limit(n)


def latest_feed(log: DataFrame, n: int = fv.FEED_ENTRIES) -> DataFrame:
    return retain_latest(log, n)


def flagged_count(feed: DataFrame) -> DataFrame:
    return feed.agg(F.count_if(F.col("status") == "FLAGGED").alias("flagged_count"))
