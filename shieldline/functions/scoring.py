"""Score stages: one INT column each, then summed and capped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .normalize import RX_BEFORE_ARABIC, arabic_fold, arabic_fold_py, bound, intent_score
from .regex import ALNUM, BOW, EOW, WORD, ci, portable

RX_CODE = [ci(portable(p)) for p in fv.CODE_PATTERNS]
#: In every text that a code pattern matches.
RX_CODE_WORD = "(?=[wWcCeEhHpPsSdDlLrRfF])" + ci("(?:while|console|exploit|hidden|prompt|divulge|leak|expose|reveal|eval|document|window|fetch)")
RX_BENIGN = ci(BOW + "(?:" + "|".join(fv.BENIGN_CODE_WORDS) + ")" + EOW)
FOLDED_PHRASES = [arabic_fold_py(p) for p in fv.ARABIC_PHRASES]
RX_KEYWORD = f"[^{ALNUM[:26]}](?=[{''.join(sorted({w[0] for w in fv.DANGEROUS_KEYWORDS}))}])(?:" + "|".join(fv.DANGEROUS_KEYWORDS) + ")"  # behind a blank or other text


def benign_code(raw: Column) -> Column:
    return raw.rlike(RX_BENIGN)


def code_score(raw: Column) -> Column:
    fired = sum((F.when(raw.rlike(p), fv.W_CODE_PATTERN).otherwise(0) for p in RX_CODE), F.lit(0))
    fired = F.when(raw.rlike(RX_CODE_WORD), fired).otherwise(0)
    return bound(fired, lambda n: F.when((n == 0) & benign_code(raw), F.lit(fv.W_BENIGN_CODE)).otherwise(n)).cast("int")


def arabic_phrase_score(raw: Column) -> Column:
    """+130 for every phrase contained in the folded raw text.  Duplicates
    after folding are kept, so two spellings of one phrase both score."""
    def scored(cleaned: Column) -> Column:
        return sum((F.when(F.instr(cleaned, p) > 0, fv.W_ARABIC_PHRASE).otherwise(0) for p in FOLDED_PHRASES), F.lit(0))

    # A phrase needs a letter beyond U+05FF, or is one of ASCII letters.
    some = ~raw.rlike(RX_BEFORE_ARABIC)
    for p in FOLDED_PHRASES:
        some = some | raw.contains(p) if p.isascii() else some
    return F.when(some, bound(arabic_fold(raw), scored)).otherwise(0).cast("int")


def words(text: Column) -> Column:
    """Python's ``re.findall(r"\\b\\w+\\b", text.lower())``."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}+"), 0)


def keyword_score(normalized: Column) -> Column:
    hits = F.filter(words(normalized), lambda w: w.isin(fv.DANGEROUS_KEYWORDS))
    return F.when(F.concat(F.lit(" "), F.lower(normalized)).rlike(RX_KEYWORD), F.size(hits) * fv.W_KEYWORD).otherwise(0).cast("int")


def total_score(*parts: Column) -> Column:
    """The sum, capped; a part that is null (of a null text) counts as 0."""
    s = F.lit(0)
    for p in parts:
        s = s + F.coalesce(p, F.lit(0))
    return F.least(s, F.lit(fv.SCORE_CAP)).cast("int")


def base_decision(score: Column) -> Column:
    return (
        F.when(score >= fv.THRESHOLD_BLOCKED, "BLOCKED")
        .when(score >= fv.THRESHOLD_FLAG, "FLAG")
        .otherwise("SAFE")
    )


def threshold_override(score: Column, decision: Column, threshold: int | None) -> Column:
    """Custom block threshold; 120 (the default) means no override."""
    if threshold is None or threshold == fv.THRESHOLD_BLOCKED:
        return decision
    return (
        F.when(score >= threshold, "BLOCKED")
        .when(decision == "BLOCKED", "FLAG")
        .otherwise(decision)
    )


__all__ = [
    "intent_score", "code_score", "arabic_phrase_score", "keyword_score",
    "total_score", "base_decision", "threshold_override", "benign_code", "words",
]
