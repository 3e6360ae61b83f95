"""Decision fusion: rule bump, model gate and fusion, strict mode, final
fields and the readable reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .rules import truncate


def rule_bump(score: Column, decision: Column, hit: Column) -> dict[str, Column]:
    """Any rule hit on a not-yet-BLOCKED verdict makes it BLOCKED with a score
    of at least 130; the intermediate FLAG/85 step always collapses into it."""
    promote = hit & (decision != "BLOCKED")
    return {
        "regex_score_bump": F.when(promote, F.greatest(F.lit(fv.REGEX_BLOCK_SCORE) - score, F.lit(0)))
                             .otherwise(F.lit(0)).cast("int"),
        "score_after_regex": F.when(promote, F.greatest(score, F.lit(fv.REGEX_BLOCK_SCORE)))
                              .otherwise(score).cast("int"),
        "decision_after_regex": F.when(hit, F.lit("BLOCKED")).otherwise(decision),
    }


def model_gate(score: Column, decision: Column, use_ai: bool | Column = True) -> Column:
    in_band = score.between(fv.AI_GATE_LOW, fv.AI_GATE_HIGH)
    gate = in_band | decision.isin("FLAG", "BLOCKED")
    return gate & (use_ai if isinstance(use_ai, Column) else F.lit(bool(use_ai)))


def model_fuse(score: Column, decision: Column, activated: Column,
               pred: Column, conf: Column) -> dict[str, Column]:
    p1 = activated & (pred == 1)
    block = p1 & (conf >= fv.AI_BLOCK_CONF)
    flag = p1 & (conf < fv.AI_BLOCK_CONF) & (conf >= fv.AI_FLAG_CONF) & (decision == "SAFE")
    unflag = activated & (F.coalesce(pred, F.lit(-1)) != 1) & (decision == "FLAG") & (conf < fv.AI_SAFE_CONF)
    new_score = (
        F.when(block, F.greatest(score, F.lit(fv.AI_BLOCK_SCORE)))
        .when(flag, F.greatest(score, F.lit(fv.AI_FLAG_SCORE)))
        .when(unflag, F.least(score, F.lit(fv.AI_SAFE_SCORE_CAP)))
        .otherwise(score)
    ).cast("int")
    new_decision = (
        F.when(block, F.lit("BLOCKED")).when(flag, F.lit("FLAG")).when(unflag, F.lit("SAFE"))
        .otherwise(decision)
    )
    contribution = F.when(block | flag, new_score - score).otherwise(F.lit(0)).cast("int")
    return {"score_after_ai": new_score, "decision_after_ai": new_decision,
            "ai_score_contribution": contribution}


def block_on_flag(decision: Column, strict: bool) -> Column:
    return F.when(decision == "FLAG", F.lit("BLOCKED")).otherwise(decision) if strict else decision


def ai_label(pred: Column) -> Column:
    return F.when(pred == 1, "MALICIOUS").when(pred == 0, "SAFE")


def activation_reason(activated: Column, use_ai: bool, score: Column, decision: Column) -> Column:
    if not use_ai:
        return F.lit(fv.TEXT_AI_OFF)
    in_band = score.between(fv.AI_GATE_LOW, fv.AI_GATE_HIGH)
    return (
        F.when(activated & in_band, F.format_string(fv.TEXT_AI_BAND, score))
        .when(activated, F.format_string(fv.TEXT_AI_CONFIRM, decision))
        .otherwise(F.format_string(fv.TEXT_AI_SKIPPED, score, decision))
    )


def conf2(conf: Column) -> Column:
    """Confidence as the two-decimal text of the 4-decimal rounded value."""
    return F.format_string("%.2f", F.bround(F.bround(conf, 4), 2))


def reason_text(c: dict[str, Column]) -> Column:
    """Composed explanation; ``c`` holds decision, score, first_match,
    intent/arabic_kw/code/keyword scores, per-layer fired/category/count,
    ai_activated, ai_label, ai_confidence."""
    safe = F.concat(
        F.lit(fv.TEXT_SAFE), c["score"].cast("string"), F.lit("/300)."),
        F.when(c["ai_activated"] & (c["ai_label"] == "SAFE"),
               F.concat(F.lit(fv.TEXT_AI_SAFE), conf2(c["ai_confidence"]), F.lit(")."))
               ).otherwise(F.lit("")),
    )

    def part(cond, *pieces):
        return F.when(cond, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pieces]))

    flagged = F.concat_ws(
        " ",
        F.concat(F.lit("Decision: "), c["decision"], F.lit(" | Score: "), c["score"].cast("string"), F.lit("/300.")),
        part(c["intent_score"] > 0, fv.TEXT_INTENT, c["intent_score"].cast("string"), ")."),
        part(c["arabic_kw_score"] > 0, fv.TEXT_ARABIC, c["arabic_kw_score"].cast("string"), ")."),
        part(c["code_score"] > 0, fv.TEXT_CODE, c["code_score"].cast("string"), ")."),
        part(c["keyword_score"] > 0, fv.TEXT_KEYWORDS, c["keyword_score"].cast("string"), ")."),
        part(c["ar_fired"], "[P2-AR] ", c["ar_category"], " (", c["ar_count"].cast("string"), fv.TEXT_MATCHED),
        part(c["en_fired"], "[P2-EN] ", c["en_category"], " (", c["en_count"].cast("string"), fv.TEXT_MATCHED),
        part(c["first_match"].isNotNull(), fv.TEXT_FIRST, truncate(c["first_match"], fv.REASON_MATCH_LEN)),
        part(c["ai_activated"] & c["ai_label"].isNotNull(), "[P3-AI] ", c["ai_label"], " (confidence=",
             conf2(F.coalesce(c["ai_confidence"], F.lit(0.0))), ")."),
    )
    return F.when(c["decision"] == "SAFE", safe).otherwise(flagged)
