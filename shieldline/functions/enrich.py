"""Dashboard enrichment of a verdict: status, risk band, decision source,
attack vector and the six-axis language profile (all computed on raw text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .normalize import bound
from .regex import ALNUM, BOW, EOW

RX_FRANCO = (
    f"(?=[a-zA-Z{fv.FRANCO_DIGITS}]){BOW}(?:(?=[a-zA-Z]*[{fv.FRANCO_DIGITS}])[a-zA-Z{fv.FRANCO_DIGITS}]++{EOW}"
    "|(?i:" + "|".join(fv.FRANCO_WORDS) + f"){EOW})"
)


def status_label(is_blocked: Column, is_flagged: Column) -> Column:
    return F.when(is_blocked, "BLOCKED").when(is_flagged, "FLAGGED").otherwise("SAFE")


def risk_band(score: Column) -> Column:
    return (
        F.when(score >= fv.RISK_CRITICAL, "CRITICAL")
        .when(score >= fv.RISK_HIGH, "HIGH")
        .when(score >= fv.RISK_MEDIUM, "MEDIUM")
        .otherwise("LOW")
    )


def decision_source(ai_prediction: Column, matched_pattern: Column) -> Column:
    ai = ai_prediction.isNotNull()
    rx = F.coalesce(F.length(matched_pattern) > 0, F.lit(False))
    return (
        F.when(ai & rx, "AI+Regex").when(ai, "AI").when(rx, "Regex").otherwise("Pipeline")
    )


def classify_vector(matched_pattern: Column, raw: Column) -> Column:
    corpus = F.concat(F.coalesce(matched_pattern, F.lit("")), F.lit(" "), raw)
    out = F.lit(fv.VECTOR_NONE)
    for pattern, label in reversed(fv.VECTOR_RULES):
        out = F.when(corpus.rlike("(?is)" + pattern), F.lit(label)).otherwise(out)
    return out


def vector_color(vector: Column) -> Column:
    m = F.create_map(*[x for k, v in fv.VECTOR_COLORS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, vector), F.lit(fv.VECTOR_COLOR_DEFAULT))


#: ``RE_ENCODED``, read from the beginning of a run only.
_DATA, _HEX = ALNUM + "+/=", "0123456789abcdefABCDEF"
RX_ENCODED = f"(?<![{_DATA}])[{_DATA}]{{20}}|(?<![{_HEX}])[{_HEX}]{{16}}"
RX_BEFORE_GREEK = r"^[\x{0}-\x{36F}]*+\z"

LANG_TYPE = "struct<" + ",".join(f"{a}:double" for a in fv.LANG_AXES) + ">"


def classify_language(raw: Column, franco_enabled: bool = True) -> Column:
    arabic, low = raw.rlike(fv.RE_ARABIC_CHAR), F.lower(raw)
    signs = F.struct(
        arabic.alias("arabic"),
        (raw.rlike(RX_FRANCO) if franco_enabled else F.lit(False)).alias("franco"),
        (~raw.rlike(RX_BEFORE_GREEK) & raw.rlike(fv.RE_UNICODE_OBFUSCATION)).alias("unicode"),
        raw.rlike(RX_ENCODED).alias("encoded"), raw.rlike(fv.RE_ENGLISH).alias("english"),
        F.when(arabic, bound(low, _egyptian)).otherwise(0).alias("egypt"))
    return bound(signs, _profile)


def _egyptian(lower: Column) -> Column:
    return sum((F.when(F.instr(lower, m) > 0, 1).otherwise(0) for m in fv.EGYPTIAN_MARKERS), F.lit(0))


def _profile(signs: Column) -> Column:
    has_arabic, has_franco, has_unicode, has_encoded, has_english, egypt = (
        signs[x] for x in ("arabic", "franco", "unicode", "encoded", "english", "egypt"))
    return F.struct(
        F.when(has_arabic & (egypt == 0), fv.LANG_MSA_ONLY)
         .when(has_arabic, fv.LANG_MSA_MIXED).otherwise(0.0).alias("msa"),
        F.when(has_arabic, F.least(egypt * fv.LANG_EGYPTIAN_PER_MARKER, F.lit(fv.LANG_EGYPTIAN_CAP)))
         .otherwise(0.0).cast("double").alias("egyptian"),
        F.when(has_franco, fv.LANG_FRANCO).otherwise(0.0).alias("franco"),
        F.when(has_english & ~has_arabic, fv.LANG_ENGLISH_ONLY)
         .when(has_english, fv.LANG_ENGLISH_MIXED).otherwise(0.0).alias("english"),
        F.when(has_unicode, fv.LANG_UNICODE).otherwise(0.0).alias("unicode"),
        F.when(has_encoded, fv.LANG_ENCODED).otherwise(0.0).alias("encoded"),
    )
