"""Detection quality against labels, and PII masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv

# PII patterns: the national-ID rule is the policy's; phone and e-mail follow
# the masks the dashboard shows.
PII_PATTERNS = [
    ("NATIONAL_ID", r"(?<![0-9])" + fv.RE_NATIONAL_ID.replace(r"\d", "[0-9]") + r"(?![0-9])"),
    ("PHONE", r"(?<![0-9])01[0125][0-9]{8}(?![0-9])"),
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("PASSWORD", r"(?i)(?<=password[:=]|password: |password is )[^ \t\r\n]+"),
]


def mask_pii(text: Column, national_id: bool = True) -> tuple[Column, dict[str, Column]]:
    """Masked text and per-type match counts (counted on the text as it is
    before that type is masked).  A number within a longer one is no match.
    ``national_id`` is the policy of that name."""
    counts = {}
    t = text
    for kind, pat in PII_PATTERNS:
        if kind == "NATIONAL_ID" and not national_id:
            continue
        counts[kind] = F.regexp_count(t, F.lit(pat))
        t = F.regexp_replace(t, pat, f"[REDACTED:{kind}]")
    return t, counts


def detection_quality(screened: DataFrame, labels: DataFrame, key: str = "prompt_key") -> DataFrame:
    """Confusion counts, precision, recall and F1 of ``is_flagged`` against
    ``labels.toxic``.  One shuffle join on the key, then a global aggregate
    of partial sums."""
    j = screened.select(F.col(key).alias("doc_id"), "is_flagged").join(
        labels.select("doc_id", "toxic"), "doc_id")
    pred, truth = F.col("is_flagged"), F.col("toxic") == 1
    c = j.agg(F.count_if(pred & truth).alias("tp"), F.count_if(pred & ~truth).alias("fp"),
              F.count_if(~pred & ~truth).alias("tn"), F.count_if(~pred & truth).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    return c.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6)).withColumn(
        "f1", F.round(F.when(F.col("precision") + F.col("recall") > 0,
                             2 * p * r / (p + r)), 6))

