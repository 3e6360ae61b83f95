"""The screening jobs: normalise → score → match rules → (model) → verdict →
enrich.  Every stage is a column expression, so a screening job over any
table is one narrow, shuffle-free projection (plus an Arrow hop for the gated
Python stages).  The only optional shuffle is the predictions-table join."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from ..functions import enrich as en
from ..functions import matching as mt
from ..functions import normalize as nz
from ..functions import rules as rl
from ..functions import scoring as sc
from ..functions import verdict as vd
from ..functions.regex import ALNUM, BOW, EOW, SPACE
from ..functions.unicode_udf import fixups_gate, python_fixups
from . import rule_tables as rt
from . import user_tables as ut
from .model import score_with_pipeline


@dataclass(frozen=True)
class Policies:
    """Stage switches.  Defaults reproduce the reference, which runs every
    stage (ROT13 included) whatever its stored policy says.  Tags and HTML
    entities are undone whatever the policy."""
    unicode_norm: bool = True     # look-alike letters and NFKC
    base64_hex: bool = True
    rot13: bool = True
    split_letter: bool = True
    franco: bool = True
    ai_layer: bool = True         # the model layer, if there is a model
    national_id: bool = True      # masking of national ids (``mask_pii``)
    slang: bool = True            # declared only: the service has no code for it


DEFAULT_POLICIES = Policies()

# Python-style transformation report patterns (on the raw text).
RX_FLAG_B64 = fv.RE_BASE64_RUN
RX_FLAG_HEX = f"{BOW}[0-9a-fA-F]{{8,}}{EOW}"
RX_FLAG_SPLIT = f"(?:{BOW}[A-Za-z]{EOW}{SPACE}+){{3,}}"
RX_MAYBE_HEX = "[0-9a-fA-F]{8}"                                   # in every text that the patterns
RX_MAYBE_SPLIT = f"(?<![{ALNUM}])[{ALNUM[:52]}](?![{ALNUM}]){SPACE}+[A-Za-z]{SPACE}"  # above match
RX_FLAG_REPEAT = nz.RX_REPEAT


def normalize_prompts(df: DataFrame, text_col: str = "text",
                      policies: Policies = DEFAULT_POLICIES, lexicon: DataFrame | None = None) -> DataFrame:
    """Adds ``normalized_text``, ``transformations`` and the intent stage
    (``intent_score`` plus the rewritten text ``intent_text``).  ``lexicon``
    (word) takes the place of the built-in one for ROT13; it is a batch job."""
    raw = F.col(text_col)
    sig = nz.intent_signals(raw)
    df = df.withColumns({
        "_loop": sig["loop"], "_n_console": sig["n_console"],
        "_n_evil": sig["n_evil"], "_classic": sig["classic"],
        "_gate": fixups_gate(raw, policies.unicode_norm),
    })
    loop, n_console, n_evil, classic = (F.col(c) for c in ("_loop", "_n_console", "_n_evil", "_classic"))
    df = df.withColumns({
        "intent_score": (
            F.when(loop, fv.W_INFINITE_LOOP).otherwise(0) + n_console * fv.W_CONSOLE_LEAK
            + n_evil * fv.W_EVIL_CALL + F.when(classic, fv.W_CLASSIC_PHRASE).otherwise(0)
        ).cast("int"),
        "intent_text": nz.rewritten(raw, loop, n_console, n_evil, classic),
    })
    df = df.withColumn("_fix", python_fixups(raw, F.col("intent_text"), policies.unicode_norm, F.col("_gate")))
    steps = [nz.strip_tags, nz.arabic_fold, nz.drop_emoji]
    if policies.base64_hex:
        steps += [nz.decode_base64_runs, nz.decode_hex_runs]
    mode = "full" if policies.unicode_norm else "rot13"
    flips, start = None, F.col("_fix.text")
    if lexicon is not None and policies.rot13:
        df = ut.with_flips(nz.stages(df, start, steps, "_decoded"), "_decoded", lexicon)
        flips, start, steps = F.col("_flips"), F.col("_decoded"), []
    steps.append(lambda t: nz.deobfuscate_tokens(t, policies.rot13, mode, flips))
    if policies.split_letter:
        steps += [nz.merge_spaced_runs, nz.merge_single_letters]
    df = nz.stages(df, start, [*steps, nz.collapse_repeats], "normalized_text")

    norm = F.col("normalized_text")
    flags = [
        (raw.rlike(RX_FLAG_B64) & (norm != raw), "base64_decode"),
        (raw.rlike(RX_MAYBE_HEX) & raw.rlike(RX_FLAG_HEX), "hex_decode"),
        (F.col("_fix.nfkc_changed"), "unicode_nfkc"),
        (F.col("_fix.html_changed"), "html_unescape"),
        (raw.rlike(RX_MAYBE_SPLIT) & raw.rlike(RX_FLAG_SPLIT), "split_letter_merge"),
        (raw.rlike(RX_FLAG_REPEAT), "repetition_collapse"),
        (raw.rlike(fv.RE_ARABIC_VARIANTS), "arabic_normalize"),
    ]
    arr = F.array_compact(F.array(*[F.when(c, F.lit(label)) for c, label in flags]))
    df = df.withColumn("transformations",
                       nz.bound(arr, lambda a: F.when(F.size(a) == 0, F.array(F.lit(fv.TRANSFORM_NONE))).otherwise(a)))
    return df.drop("_loop", "_n_console", "_n_evil", "_classic", "_gate", "_fix", "_flips", "_decoded")


def score_prompts(df: DataFrame, text_col: str = "text", threshold: int | None = None,
                  phrases: DataFrame | None = None, keywords: DataFrame | None = None) -> DataFrame:
    """Needs ``normalize_prompts`` columns.  Adds the Phase-1 scores,
    ``base_score`` and ``pipeline_decision``.  ``phrases`` (phrase) and
    ``keywords`` (word) take the place of the built-in lists."""
    raw = F.col(text_col)
    df = df.withColumn("code_score", sc.code_score(raw))
    df = (df.withColumn("arabic_kw_score", sc.arabic_phrase_score(raw)) if phrases is None
          else ut.with_phrase_score(df, text_col, phrases))
    df = (df.withColumn("keyword_score", sc.keyword_score(F.col("normalized_text"))) if keywords is None
          else ut.with_keyword_score(df, "normalized_text", keywords))
    df = df.withColumn("base_score", sc.total_score(
        F.col("intent_score"), F.col("code_score"), F.col("arabic_kw_score"), F.col("keyword_score")))
    decision = sc.base_decision(F.col("base_score"))
    return df.withColumn("pipeline_decision",
                         sc.threshold_override(F.col("base_score"), decision, threshold))


def _with_hits(df: DataFrame, pack: rl.RulePack, layers: tuple[str, ...]) -> DataFrame:
    """``df`` with the hits of each layer, from broadcasts of the pack."""
    ordered = [r for layer in layers for r in pack.layer(layer)]
    parts = mt.rule_hits(df.sparkSession, F.col("normalized_text"), ordered, layers)
    df = df.withColumns({f"_part{i}": p for i, p in enumerate(parts)})
    df = df.withColumns({f"_{layer[:2]}_hits": F.concat(*[F.col(f"_part{i}.{layer}") for i in range(len(parts))]) for layer in layers})
    return df.drop(*[f"_part{i}" for i in range(len(parts))])


def match_rules(df: DataFrame, pack: rl.RulePack | DataFrame) -> DataFrame:
    """Phase 2 on ``normalized_text``: per-layer hits and their summaries,
    then the rule bump on ``base_score``/``pipeline_decision``.  A pack that is
    too large for a worker is given as its table (a batch job)."""
    layers = ("arabic", "english")
    df = rt.with_hits(df, "normalized_text", pack, layers) if isinstance(pack, DataFrame) else _with_hits(df, pack, layers)
    ar = rl.layer_summary(F.col("_ar_hits"))
    en = rl.layer_summary(F.col("_en_hits"))
    df = df.withColumns({
        "ar_fired": ar["fired"], "ar_category": ar["category"],
        "ar_match_count": ar["match_count"], "ar_patterns": ar["display"],
        "en_fired": en["fired"], "en_category": en["category"],
        "en_match_count": en["match_count"], "en_patterns": en["display"],
        "matched_pattern": F.coalesce(ar["first"], en["first"]),
        "matched_rule_id": F.coalesce(F.try_element_at(F.col("_ar_hits"), F.lit(1))["rule_id"],
                                      F.try_element_at(F.col("_en_hits"), F.lit(1))["rule_id"]),
        "all_matched_patterns": rl.all_matched(F.col("_ar_hits"), F.col("_en_hits")),
        "matched_rule_ids": F.concat(F.transform("_ar_hits", lambda h: h["rule_id"]),
                                     F.transform("_en_hits", lambda h: h["rule_id"])),
    })
    bump = vd.rule_bump(F.col("base_score"), F.col("pipeline_decision"),
                        F.col("matched_pattern").isNotNull())
    return df.withColumns(bump).drop("_ar_hits", "_en_hits")


# ---------------------------------------------------------------------------
# model layer
# ---------------------------------------------------------------------------
Scorer = Callable[[pd.Series], tuple[np.ndarray, np.ndarray]]


def keyword_density_scorer(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Deterministic stand-in classifier (no weights ship with this repo):
    P(malicious) rises with the share of dangerous keywords among words."""
    kw = set(fv.DANGEROUS_KEYWORDS)
    preds, confs = [], []
    for t in texts:
        words = t.split()
        hits = sum(1 for w in words if w in kw)
        p = min(0.5 + 2.0 * hits / max(len(words), 1), 0.99) if hits else 0.2
        pred = 1 if p >= 0.5 else 0
        preds.append(pred)
        confs.append(round(p if pred == 1 else 1.0 - p, 4))
    return np.array(preds, dtype="int32"), np.array(confs, dtype="float64")


def _run_scorer(scorer: Scorer, text: pd.Series, mask: np.ndarray):
    pred = pd.array([None] * len(text), dtype="Int32")
    conf = pd.array([None] * len(text), dtype="Float64")
    if mask.any():
        try:
            p, c = scorer(text[mask])
        except Exception:                      # model failure → (0, 0.0)
            p = np.zeros(int(mask.sum()), dtype="int32")
            c = np.zeros(int(mask.sum()))
        pred[mask] = p
        conf[mask] = c
    return pred, conf


def score_gated(df: DataFrame, scorer: Scorer) -> DataFrame:
    """Run ``scorer`` over the gated rows of each Arrow batch.  ``mapInPandas``
    is a plan node over already-computed columns, so the long screening
    projection below it is evaluated once and never inlined into the model
    input; ungated rows pass through unscored."""
    schema = T.StructType(list(df.schema.fields) + [
        T.StructField("ai_prediction", T.IntegerType()), T.StructField("ai_confidence", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            mask = pdf["ai_activated"].fillna(False).to_numpy(dtype=bool)
            pred, conf = _run_scorer(scorer, pdf["normalized_text"], mask)
            yield pdf.assign(ai_prediction=pred, ai_confidence=conf)

    return df.mapInPandas(run, schema)


def with_predictions(df: DataFrame, predictions: DataFrame) -> DataFrame:
    """Joins ``_model`` = (ai_prediction, ai_confidence) by prompt_id, one row
    per prompt (of several, the greatest).  Joined to prompts before they are
    screened, so that only (id, text) is shuffled.  A row with a NULL prediction
    is a failure of the model: (0, 0.0); no row leaves ``_model`` NULL."""
    one = predictions.groupBy("prompt_id").agg(F.max(F.struct(
        F.col("ai_prediction").cast("int").alias("p"), F.col("ai_confidence").cast("double").alias("c"))).alias("_m"))
    model = F.when(F.col("_m.p").isNull(), F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("c"))).otherwise(
        F.struct(F.col("_m.p").alias("p"), F.coalesce("_m.c", F.lit(0.0)).alias("c")))
    return df.join(one.select("prompt_id", model.alias("_model")), "prompt_id", "left")


def apply_model(df: DataFrame, model=None, use_ai: bool = True) -> DataFrame:
    """Phase 3.  ``model`` is None (layer off), a pipeline fitted by
    ``operators.model``, a scorer callable (run through an Arrow UDF on gated
    rows only — ungated rows pass NULL), or a predictions DataFrame
    ``(prompt_id, ai_prediction, ai_confidence)``."""
    enabled = use_ai and model is not None
    score, decision = F.col("score_after_regex"), F.col("decision_after_regex")
    df = df.withColumn("ai_activated", vd.model_gate(score, decision, enabled))
    if not enabled:
        df = df.withColumns({"ai_prediction": F.lit(None).cast("int"),
                             "ai_confidence": F.lit(None).cast("double")})
    elif isinstance(model, PipelineModel):
        df = score_with_pipeline(df, model)
    elif isinstance(model, DataFrame):
        if "_model" not in df.columns:
            df = with_predictions(df, model)
        act = F.col("ai_activated")
        # A gated prompt without a prediction is not scored yet: its verdict stays.
        df = df.withColumns({"ai_prediction": F.when(act, F.col("_model.p")),
                             "ai_confidence": F.when(act, F.col("_model.c"))}).drop("_model")
    else:
        df = score_gated(df, model)
    fused = vd.model_fuse(score, decision, F.col("ai_activated"),
                          F.col("ai_prediction"), F.col("ai_confidence"))
    return df.withColumns(fused).withColumns({
        "ai_reason": F.when(F.col("ai_activated") & F.col("ai_prediction").isNull(), "no prediction").otherwise(
            vd.activation_reason(F.col("ai_activated"), enabled, score, decision)),
        "ai_label": vd.ai_label(F.col("ai_prediction")),
    })


def final_verdict(df: DataFrame, strict: bool = False) -> DataFrame:
    decision = vd.block_on_flag(F.col("decision_after_ai"), strict)
    df = df.withColumns({
        "decision": decision,
        "score": F.least(F.col("score_after_ai"), F.lit(fv.SCORE_CAP)).cast("int"),
    })
    df = df.withColumns({
        "is_blocked": F.col("decision") == "BLOCKED",
        "is_flagged": F.col("decision").isin("FLAG", "BLOCKED"),
        "ai_confidence_rounded": F.bround("ai_confidence", 4),
    })
    reason = vd.reason_text({
        "decision": F.col("decision"), "score": F.col("score"),
        "first_match": F.col("matched_pattern"),
        "intent_score": F.col("intent_score"), "arabic_kw_score": F.col("arabic_kw_score"),
        "code_score": F.col("code_score"), "keyword_score": F.col("keyword_score"),
        "ar_fired": F.col("ar_fired"), "ar_category": F.col("ar_category"), "ar_count": F.col("ar_match_count"),
        "en_fired": F.col("en_fired"), "en_category": F.col("en_category"), "en_count": F.col("en_match_count"),
        "ai_activated": F.col("ai_activated"), "ai_label": F.col("ai_label"),
        "ai_confidence": F.col("ai_confidence"),
    })
    return df.withColumn("reason", reason)


def enrich_verdicts(df: DataFrame, text_col: str = "text", source: str = "prompt",
                    logged_at: str | Column | None = None,
                    policies: Policies = DEFAULT_POLICIES) -> DataFrame:
    """Dashboard metadata.  ``id`` is a hash of the prompt key instead of a
    random UUID, so a re-run after an executor loss reproduces the same log."""
    raw = F.col(text_col)
    ts = logged_at if isinstance(logged_at, Column) else (
        F.lit(logged_at).cast("timestamp") if logged_at else F.current_timestamp())
    return df.withColumns({
        "id": F.substring(F.sha2(F.concat_ws(":", F.lit(source), F.col("prompt_id")), 256), 1, 32),
        "timestamp": ts,
        "status": en.status_label(F.col("is_blocked"), F.col("is_flagged")),
        "risk": en.risk_band(F.col("score")),
        "vector": en.classify_vector(F.col("matched_pattern"), raw),
        "decision_source": en.decision_source(F.col("ai_prediction"), F.col("matched_pattern")),
        "lang_dist": en.classify_language(raw, policies.franco),
    })


def screen_prompts(df: DataFrame, pack: rl.RulePack, text_col: str = "text", *,
                   model=None, use_ai: bool = True, threshold: int | None = None,
                   strict: bool = False, policies: Policies = DEFAULT_POLICIES,
                   source: str = "prompt", logged_at: str | Column | None = None,
                   enrich: bool = True, lexicon: DataFrame | None = None,
                   phrases: DataFrame | None = None, keywords: DataFrame | None = None) -> DataFrame:
    """The whole analysis (SDK ``analyze``/``batch_analyze`` + engine
    enrichment) as one job over a table of prompts.  ``lexicon``, ``phrases``
    and ``keywords`` are the user's tables in place of the built-in lists."""
    use_ai = use_ai and policies.ai_layer
    if use_ai and isinstance(model, DataFrame):
        df = with_predictions(df, model)
    out = normalize_prompts(df, text_col, policies, lexicon)
    out = score_prompts(out, text_col, threshold, phrases, keywords)
    out = match_rules(out, pack)
    out = apply_model(out, model, use_ai)
    out = final_verdict(out, strict)
    out = out.withColumn("pipeline_steps", pipeline_steps(text_col))
    if enrich:
        out = enrich_verdicts(out, text_col, source, logged_at, policies)
    return out


#: What the phases before the model give to the model and the verdict.
BEFORE_MODEL = ["normalized_text", "intent_score", "code_score", "arabic_kw_score", "keyword_score", "ar_fired", "ar_category", "ar_match_count",
                "en_fired", "en_category", "en_match_count", "matched_pattern", "score_after_regex", "decision_after_regex"]


def screen_again(screened: DataFrame, model, use_ai: bool = True, strict: bool = False) -> DataFrame:
    """The verdicts of another model on prompts that have been screened.  The
    phases before the model do not depend on it: ``screened`` holds their
    columns (``BEFORE_MODEL``), and no text is normalised, scored or matched anew."""
    return final_verdict(apply_model(screened, model, use_ai), strict)


def pipeline_steps(text_col: str = "text") -> Column:
    """The nested report of the three phases, as the log keeps it."""
    def layer(a: str) -> Column:
        return F.struct(F.col(f"{a}_fired").alias("fired"), F.col(f"{a}_category").alias("category"),
                        F.col(f"{a}_match_count").alias("match_count"), F.col(f"{a}_patterns").alias("matched_patterns"))

    return F.struct(
        F.struct(F.col(text_col).alias("raw_input"), "normalized_text", "intent_score", "code_score", "arabic_kw_score",
                 "keyword_score", "base_score", "pipeline_decision", "transformations").alias("phase_1_normalization"),
        F.struct(F.lit("normalized_text").alias("ran_on"), layer("ar").alias("arabic"), layer("en").alias("english"),
                 "regex_score_bump", "score_after_regex", "decision_after_regex").alias("phase_2_regex"),
        F.struct(F.col("ai_activated").alias("activated"), F.col("ai_reason").alias("reason"), F.col("ai_prediction").alias("prediction"),
                 F.col("ai_confidence_rounded").alias("confidence"), F.col("ai_label").alias("label"),
                 F.col("ai_score_contribution").alias("score_contribution"), "decision_after_ai").alias("phase_3_ai"),
        F.col("score").alias("final_score"), F.col("decision").alias("final_decision"))


def check_prompts(screened: DataFrame) -> DataFrame:
    """``check`` / ``batch_check``: True for a safe prompt."""
    return screened.select("prompt_id", (~F.col("is_flagged")).alias("is_safe"))


LOG_COLUMNS = [
    "id", "timestamp", "raw", "normalized_text", "decision", "status", "risk", "score",
    "is_blocked", "is_flagged", "matched_pattern", "all_matched_patterns", "reason",
    "ai_confidence", "ai_prediction", "vector", "decision_source", "lang_dist", "pipeline_steps",
]


def to_log(screened: DataFrame, text_col: str = "text") -> DataFrame:
    """Project a screened frame onto the threat-log schema."""
    return screened.withColumn("raw", F.col(text_col)).select(*LOG_COLUMNS)
