"""Registry of the engine's queries: one Spark job per operator of the
blueprint, each paired (where SQL can express it) with DuckDB oracle SQL.

Every query reads the driver's tables (through the seeded prompt views in
``sources.prompts``) and processes them whole.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import enrich as en
from ..functions import normalize as nz
from ..functions import scoring as sc
from ..functions.rules import RulePack
from ..functions.unicode_udf import python_fixups
from ..operators import screen as S
from ..session import scratch_path
from ..sources.prompts import read_prompts, read_table, spread
from ..sources.rules_source import rules_source
from . import oracle as O

LOGGED_AT = "2024-01-30 12:00:00"
SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def pack(spark: SparkSession) -> RulePack:
    return RulePack.from_df(rules_source(spark))


def prompts(spark, sf, source="documents"):
    return spread(read_prompts(spark, sf, source))


def screened(spark, sf, source="documents", **kw) -> DataFrame:
    kw.setdefault("logged_at", LOGGED_AT)
    return S.screen_prompts(prompts(spark, sf, source), pack(spark), **kw)


def predictions(spark, sf) -> DataFrame:
    """Stand-in for an external model's output table, derived from labels:
    toxic documents are predicted malicious, confidence set by quality."""
    lab = read_table(spark, sf, "labels")
    conf = (F.when((F.col("toxic") == 1) & (F.col("quality") == 1), 0.80)
            .when(F.col("toxic") == 1, 0.60)
            .when(F.col("quality") == 0, 0.30).otherwise(0.90))
    return lab.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("prompt_id"),
                      F.col("toxic").cast("int").alias("ai_prediction"), conf.alias("ai_confidence"))


PREDICTIONS_SQL = ("SELECT 'd' || doc_id::VARCHAR AS prompt_id, toxic::INTEGER AS ai_prediction, "
                   "(CASE WHEN toxic = 1 AND quality = 1 THEN 0.80 WHEN toxic = 1 THEN 0.60 "
                   "WHEN quality = 0 THEN 0.30 ELSE 0.90 END)::DOUBLE AS ai_confidence FROM labels")

DOCS = O.prompts_sql("documents")
CONV = O.prompts_sql("conversations")


def stage_sql(expr: str, alias: str, source: str = DOCS) -> str:
    return f"SELECT prompt_id, {expr} AS {alias} FROM ({source})"


def pipe_sql(select: str, source: str = DOCS, **kw) -> str:
    kw.setdefault("logged_at", LOGGED_AT)
    return O.with_pipeline(source, select, **kw)


def stage(spark, sf, col, alias, source="documents"):
    return prompts(spark, sf, source).select("prompt_id", col.alias(alias))


# ---------------------------------------------------------------------------
# 2.1 sources
# ---------------------------------------------------------------------------
@register("read_prompts", f"SELECT prompt_id, text FROM ({CONV})")
def q_read_prompts(spark, sf):
    return read_prompts(spark, sf, "conversations").select("prompt_id", "text")


@register("validate_prompts",
          f"SELECT prompt_id, CASE WHEN text IS NULL THEN 'missing' WHEN length(text) < 1 THEN 'empty' "
          f"WHEN length(text) > {fv.MAX_TEXT_CHARS} THEN 'too_long' END AS reject_reason, "
          f"(text IS NOT NULL AND length(text) BETWEEN 1 AND {fv.MAX_TEXT_CHARS}) AS valid FROM ({DOCS})")
def q_validate(spark, sf):
    from ..sources.prompts import validate_prompts
    return validate_prompts(read_prompts(spark, sf, "documents")).select("prompt_id", "reject_reason", "valid")


# ---------------------------------------------------------------------------
# 2.2 normalisation stages
# ---------------------------------------------------------------------------
@register("norm_intent_rewrite", stage_sql(O.intent_rewrite("text"), "intent_text"))
def q_norm_intent(spark, sf):
    return stage(spark, sf, nz.intent_rewrite(F.col("text")), "intent_text")


@register("norm_nfkc", stage_sql(O.html_unescape(O.nfkc("text")), "nfkc_text"))
def q_norm_nfkc(spark, sf):
    t = F.col("text")
    return stage(spark, sf, python_fixups(t, t)["text"], "nfkc_text")


PAGES_HTML_SQL = (f"SELECT page_id, {O.strip_tags(O.html_unescape('html'))} AS text FROM pages")


@register("norm_html", PAGES_HTML_SQL)
def q_norm_html(spark, sf):
    pages = spread(read_table(spark, sf, "pages"))
    h = F.col("html")
    return pages.select("page_id", nz.strip_tags(python_fixups(h, h)["text"]).alias("text"))


@register("norm_arabic", stage_sql(O.arabic_fold("text"), "folded"))
def q_norm_arabic(spark, sf):
    return stage(spark, sf, nz.arabic_fold(F.col("text")), "folded")


@register("norm_emoji", stage_sql(O.drop_emoji("text"), "no_emoji"))
def q_norm_emoji(spark, sf):
    return stage(spark, sf, nz.drop_emoji(F.col("text")), "no_emoji")


@register("norm_base64", stage_sql(O.decode_base64_runs("text"), "decoded"))
def q_norm_base64(spark, sf):
    return stage(spark, sf, nz.decode_base64_runs(F.col("text")), "decoded")


@register("norm_hex", stage_sql(O.decode_hex_runs("text"), "decoded"))
def q_norm_hex(spark, sf):
    return stage(spark, sf, nz.decode_hex_runs(F.col("text")), "decoded")


@register("norm_tokens", stage_sql(O.deobfuscate_tokens("text", mode="join"), "tokens_text"))
def q_norm_tokens(spark, sf):
    return stage(spark, sf, nz.deobfuscate_tokens(F.col("text"), mode="join"), "tokens_text")


@register("norm_rot13", stage_sql(O.deobfuscate_tokens("text", mode="rot13"), "rot13_text"))
def q_norm_rot13(spark, sf):
    return stage(spark, sf, nz.deobfuscate_tokens(F.col("text"), mode="rot13"), "rot13_text")


@register("norm_confusables", stage_sql(O.deobfuscate_tokens("text", mode="confusables"), "deobfuscated"))
def q_norm_confusables(spark, sf):
    return stage(spark, sf, nz.deobfuscate_tokens(F.col("text"), mode="confusables"), "deobfuscated")


@register("norm_split_letters",
          stage_sql(O.merge_split_letters_pass2(O.merge_split_letters_pass1(O.deobfuscate_tokens("text", mode="join"))),
                    "merged"))
def q_norm_split(spark, sf):
    steps = [lambda t: nz.deobfuscate_tokens(t, mode="join"), nz.merge_spaced_runs, nz.merge_single_letters]
    return nz.stages(prompts(spark, sf), F.col("text"), steps, "merged").select("prompt_id", "merged")


@register("norm_collapse", stage_sql(O.collapse_repeats("text"), "collapsed"))
def q_norm_collapse(spark, sf):
    return stage(spark, sf, nz.collapse_repeats(F.col("text")), "collapsed")


@register("normalize_prompts", pipe_sql("SELECT prompt_id, normalized_text FROM screened"))
def q_normalize(spark, sf):
    return S.normalize_prompts(prompts(spark, sf)).select("prompt_id", "normalized_text")


@register("transform_flags", pipe_sql("SELECT prompt_id, transformations FROM screened"))
def q_transform_flags(spark, sf):
    return S.normalize_prompts(prompts(spark, sf)).select("prompt_id", "transformations")


@register("transform_usage", pipe_sql(
    "SELECT t AS transformation, count(*) AS n FROM (SELECT unnest(transformations) AS t FROM screened) GROUP BY t"))
def q_transform_usage(spark, sf):
    df = S.normalize_prompts(prompts(spark, sf))
    return (df.select(F.explode_outer("transformations").alias("transformation"))
            .filter(F.col("transformation").isNotNull())
            .groupBy("transformation").agg(F.count("*").alias("n")))


# ---------------------------------------------------------------------------
# 2.3 scores
# ---------------------------------------------------------------------------
@register("score_intent", stage_sql(O.intent_score("text") + "::INTEGER", "intent_score"))
def q_score_intent(spark, sf):
    return stage(spark, sf, nz.intent_score(F.col("text")), "intent_score")


@register("score_code", pipe_sql("SELECT prompt_id, code_score FROM screened"))
def q_score_code(spark, sf):
    return stage(spark, sf, sc.code_score(F.col("text")), "code_score")


@register("score_arabic_phrases", pipe_sql("SELECT prompt_id, arabic_kw_score FROM screened"))
def q_score_arabic(spark, sf):
    return stage(spark, sf, sc.arabic_phrase_score(F.col("text")), "arabic_kw_score")


def _scored(spark, sf, threshold=None):
    return S.score_prompts(S.normalize_prompts(prompts(spark, sf)), threshold=threshold)


@register("score_keywords", pipe_sql("SELECT prompt_id, keyword_score FROM screened"))
def q_score_keywords(spark, sf):
    return _scored(spark, sf).select("prompt_id", "keyword_score")


@register("score_prompts", pipe_sql(
    "SELECT prompt_id, intent_score, code_score, arabic_kw_score, keyword_score, base_score FROM screened"))
def q_score_prompts(spark, sf):
    return _scored(spark, sf).select("prompt_id", "intent_score", "code_score", "arabic_kw_score",
                                      "keyword_score", "base_score")


@register("score_total", pipe_sql("SELECT prompt_id, base_score FROM screened"))
def q_score_total(spark, sf):
    return _scored(spark, sf).select("prompt_id", "base_score")


@register("base_decision", pipe_sql("SELECT prompt_id, base_score, pipeline_decision FROM screened"))
def q_base_decision(spark, sf):
    return _scored(spark, sf).select("prompt_id", "base_score", "pipeline_decision")


@register("threshold_override", pipe_sql("SELECT prompt_id, pipeline_decision FROM screened", threshold=100))
def q_threshold(spark, sf):
    return _scored(spark, sf, threshold=100).select("prompt_id", "pipeline_decision")


@register("keyword_frequency", pipe_sql(
    "SELECT w AS keyword, count(*) AS occurrences FROM (SELECT unnest(regexp_extract_all(lower(normalized_text), "
    + O.lit(nz.WORD + "+") + ", 0)) AS w FROM screened) WHERE list_contains("
    + O.str_list(fv.DANGEROUS_KEYWORDS) + ", w) GROUP BY w"))
def q_keyword_frequency(spark, sf):
    from ..operators.corpus import keyword_frequency
    return keyword_frequency(S.normalize_prompts(prompts(spark, sf)), spark)


# ---------------------------------------------------------------------------
# 2.4 rules
# ---------------------------------------------------------------------------
def _ruled(spark, sf, **kw):
    return S.match_rules(S.score_prompts(S.normalize_prompts(prompts(spark, sf)), **kw), pack(spark))


@register("rule_any", pipe_sql("SELECT prompt_id, ar_fired, en_fired, (ar_fired OR en_fired) AS rule_any FROM screened"))
def q_rule_any(spark, sf):
    return _ruled(spark, sf).select("prompt_id", "ar_fired", "en_fired",
                                    (F.col("ar_fired") | F.col("en_fired")).alias("rule_any"))


@register("rule_first", pipe_sql("SELECT prompt_id, matched_rule_id, matched_pattern FROM screened"))
def q_rule_first(spark, sf):
    return _ruled(spark, sf).select("prompt_id", "matched_rule_id", "matched_pattern")


@register("rule_all", pipe_sql("SELECT prompt_id, matched_rule_ids, all_matched_patterns FROM screened"))
def q_rule_all(spark, sf):
    return _ruled(spark, sf).select("prompt_id", "matched_rule_ids", "all_matched_patterns")


@register("rule_category", pipe_sql("SELECT prompt_id, ar_category, en_category FROM screened"))
def q_rule_category(spark, sf):
    return _ruled(spark, sf).select("prompt_id", "ar_category", "en_category")


@register("rule_counts", pipe_sql(
    "SELECT prompt_id, ar_match_count, en_match_count, ar_patterns, en_patterns FROM screened"))
def q_rule_counts(spark, sf):
    return _ruled(spark, sf).select("prompt_id", "ar_match_count", "en_match_count", "ar_patterns", "en_patterns")


@register("rule_score_bump", pipe_sql(
    "SELECT prompt_id, regex_score_bump, score_after_regex, decision_after_regex FROM screened"))
def q_rule_bump(spark, sf):
    return _ruled(spark, sf).select("prompt_id", "regex_score_bump", "score_after_regex", "decision_after_regex")


RULE_DIM_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"({O.lit(r['rule_id'])}, {O.lit(r['layer'])}, {O.lit(r['grp'])})" for r in O.rules_rows()
) + ") AS v(rule_id, layer, grp))"


@register("rule_hits", pipe_sql(
    f"SELECT h.prompt_id, h.rule_id, d.layer, d.grp FROM (SELECT prompt_id, unnest(matched_rule_ids) AS rule_id "
    f"FROM screened) h JOIN {RULE_DIM_SQL} d USING (rule_id)"))
def q_rule_hits(spark, sf):
    from ..operators.rule_jobs import rule_hits
    return rule_hits(_ruled(spark, sf), rules_source(spark)).select("prompt_id", "rule_id", "layer", "grp")


@register("rule_group_stats", pipe_sql(
    f"SELECT d.layer, d.grp, count(DISTINCT h.prompt_id) AS prompts, count(*) AS hits FROM "
    f"(SELECT prompt_id, unnest(matched_rule_ids) AS rule_id FROM screened) h JOIN {RULE_DIM_SQL} d USING (rule_id) "
    f"GROUP BY ROLLUP (d.layer, d.grp)"))
def q_rule_group_stats(spark, sf):
    from ..operators.rule_jobs import rule_group_stats
    return rule_group_stats(_ruled(spark, sf), rules_source(spark))


def words_pack(spark, sf) -> DataFrame:
    """A pack as large as the vocabulary: one rule for every word of five ASCII
    letters or more in the documents, in the order of the words."""
    words = read_table(spark, sf, "documents").select(
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("w")).where(F.length("w") >= 5).distinct()
    return words.select(
        F.concat(F.lit("w-"), "w").alias("rule_id"), F.lit("english").alias("layer"), F.lit("words").alias("grp"),
        F.lit("Vocabulary").alias("category"), (F.conv(F.substring(F.sha2("w", 256), 1, 7), 16, 10)).cast("int").alias("ord"),
        F.array("w").alias("anchors"), F.concat(F.lit("(?:^|[^a-z])"), "w", F.lit("(?:[^a-z]|$)")).alias("pattern"), F.lit(True).alias("enabled"))


WORDS_HITS_SQL = ("SELECT prompt_id, count(*) AS hits, min_by('w-' || w, ('0x' || substr(sha256(w), 1, 7))::INTEGER) AS first FROM "
                  "(SELECT prompt_id, unnest(list_distinct(regexp_extract_all(lower(normalized_text), '[a-z]+'))) AS w FROM screened) "
                  "WHERE w IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM documents) AND length(w) >= 5 GROUP BY 1")


@register("rule_pack_of_any_size", pipe_sql(
    f"SELECT s.prompt_id, coalesce(h.hits, 0)::INTEGER AS rules_matched, h.first AS matched_rule_id, "
    f"CASE WHEN h.first IS NOT NULL AND pipeline_decision <> 'BLOCKED' THEN greatest(base_score, {fv.REGEX_BLOCK_SCORE}) ELSE base_score END::INTEGER AS score_after_regex, "
    f"CASE WHEN h.first IS NOT NULL THEN 'BLOCKED' ELSE pipeline_decision END AS decision_after_regex "
    f"FROM screened s LEFT JOIN ({WORDS_HITS_SQL}) h USING (prompt_id)", source=CONV))
def q_rule_pack_of_any_size(spark, sf):
    scored = S.score_prompts(S.normalize_prompts(prompts(spark, sf, "conversations")))
    return S.match_rules(scored, words_pack(spark, sf)).select(
        "prompt_id", F.col("en_match_count").alias("rules_matched"), "matched_rule_id", "score_after_regex", "decision_after_regex")


@register("rule_hits_as_table", pipe_sql(
    "SELECT prompt_id, 'w-' || w AS rule_id FROM (SELECT prompt_id, unnest(list_distinct(regexp_extract_all(lower(normalized_text), '[a-z]+'))) AS w FROM screened) "
    "WHERE w IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM documents) AND length(w) >= 5", source=CONV))
def q_rule_hits_as_table(spark, sf):
    from ..operators.rule_jobs import rule_hits_join
    return rule_hits_join(S.normalize_prompts(prompts(spark, sf, "conversations")), words_pack(spark, sf)).select("prompt_id", "rule_id")


# ---------------------------------------------------------------------------
# 2.11 the user's own tables in screening
# ---------------------------------------------------------------------------
def user_lexicon(spark, sf) -> DataFrame:
    """The built-in words and all words of the benchmark items."""
    own = read_table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
    return own.unionByName(spark.createDataFrame([(w,) for w in fv.LEXICON], "word string"))


LEXICON_SQL = ("SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark UNION ALL "
               f"SELECT unnest({O.str_list(fv.LEXICON)}) AS word")


@register("lexicon_table", pipe_sql("SELECT prompt_id, normalized_text, decision, score FROM screened", lexicon=LEXICON_SQL))
def q_lexicon_table(spark, sf):
    out = screened(spark, sf, lexicon=user_lexicon(spark, sf), enrich=False)
    return out.select("prompt_id", "normalized_text", "decision", "score")


def user_phrases(spark, sf) -> DataFrame:
    """The built-in phrases, and the beginning of every benchmark item (equal ones repeat)."""
    own = read_table(spark, sf, "benchmark").select(F.substring("text", 1, 9).alias("phrase"))
    return own.unionByName(spark.createDataFrame([(p,) for p in fv.ARABIC_PHRASES], "phrase string"))


PHRASES_SQL = (f"SELECT {O.arabic_fold('substr(text, 1, 9)')} AS phrase FROM benchmark UNION ALL "
               f"SELECT unnest({O.str_list(sc.FOLDED_PHRASES)}) AS phrase")


@register("phrase_table", pipe_sql("SELECT prompt_id, arabic_kw_score, base_score, decision FROM screened", phrases_in=PHRASES_SQL))
def q_phrase_table(spark, sf):
    out = screened(spark, sf, phrases=user_phrases(spark, sf), enrich=False)
    return out.select("prompt_id", "arabic_kw_score", "base_score", "decision")


@register("keyword_table", pipe_sql("SELECT prompt_id, keyword_score, base_score, decision FROM screened", keywords_in=LEXICON_SQL))
def q_keyword_table(spark, sf):
    out = screened(spark, sf, keywords=user_lexicon(spark, sf), enrich=False)
    return out.select("prompt_id", "keyword_score", "base_score", "decision")


# ---------------------------------------------------------------------------
# 2.5 model layer and fusion (predictions table derived from labels)
# ---------------------------------------------------------------------------
def screened_model(spark, sf, **kw):
    return screened(spark, sf, model=predictions(spark, sf), **kw)


def model_sql(select: str, **kw) -> str:
    return pipe_sql(select, model=PREDICTIONS_SQL, **kw)


@register("model_gate", model_sql(
    "SELECT prompt_id, score_after_regex, decision_after_regex, ai_activated FROM screened"))
def q_model_gate(spark, sf):
    return screened_model(spark, sf, enrich=False).select(
        "prompt_id", "score_after_regex", "decision_after_regex", "ai_activated")


KEYWORD_HITS = (f"len(list_filter(string_split_regex(trim(normalized_text, ' '), {O.lit(O.SPACE + '+')}), "
                f"lambda w: list_contains({O.str_list(fv.DANGEROUS_KEYWORDS)}, w)))")
KEYWORD_WORDS = f"greatest(len(list_filter(string_split_regex(normalized_text, {O.lit(O.SPACE + '+')}), lambda w: w <> '')), 1)"
DENSITY_SQL = (f"SELECT prompt_id, (p >= 0.5)::INTEGER AS ai_prediction, round_even(CASE WHEN p >= 0.5 THEN p ELSE 1.0 - p END, 4) AS ai_confidence FROM "
               f"(SELECT prompt_id, CASE WHEN {KEYWORD_HITS} > 0 THEN least(0.5 + 2.0 * {KEYWORD_HITS} / {KEYWORD_WORDS}, 0.99) ELSE 0.2 END::DOUBLE AS p FROM p6)")


@register("model_score", pipe_sql("SELECT prompt_id, ai_activated, ai_prediction, ai_confidence, decision_after_ai FROM screened", model=DENSITY_SQL))
def q_model_score(spark, sf):
    out = screened(spark, sf, model=S.keyword_density_scorer, enrich=False)
    return out.select("prompt_id", "ai_activated", "ai_prediction", "ai_confidence", "decision_after_ai")


@register("model_trained_quality")
def q_model_trained(spark, sf):
    """The pipeline fitted to reviewed entries, saved, loaded, and measured on
    the entries held out."""
    examples = materialize(MD.training_set(docs_log(spark, sf), reviews(spark, sf)), "examples")
    path = MD.save_model(MD.fit_text_model(examples.where("not held_out")), spark=spark)
    return MD.model_quality(MD.load_model(path), examples.where("held_out"))


@register("model_trained_screening")
def q_model_trained_screening(spark, sf):
    """The documents are screened for the log, and their verdicts given again by
    the pipeline that is fitted to its reviewed entries."""
    log = docs_log(spark, sf, "prompt_id", *S.BEFORE_MODEL)
    examples = MD.training_set(log, reviews(spark, sf))
    model = MD.load_model(MD.save_model(MD.fit_text_model(materialize(examples, "examples").where("not held_out")), spark=spark))
    again = S.screen_again(log.select("prompt_id", *S.BEFORE_MODEL), model)
    return again.select("prompt_id", "ai_activated", "ai_prediction", "ai_confidence", "decision", "score")


@register("model_fuse", model_sql(
    "SELECT prompt_id, ai_prediction, ai_confidence, score_after_ai, decision_after_ai, ai_label FROM screened"))
def q_model_fuse(spark, sf):
    return screened_model(spark, sf, enrich=False).select(
        "prompt_id", "ai_prediction", "ai_confidence", "score_after_ai", "decision_after_ai", "ai_label")


@register("block_on_flag", model_sql("SELECT prompt_id, decision, score FROM screened", strict=True))
def q_block_on_flag(spark, sf):
    return screened_model(spark, sf, strict=True, enrich=False).select("prompt_id", "decision", "score")


@register("final_verdict", model_sql("SELECT prompt_id, decision, score, is_blocked, is_flagged FROM screened"))
def q_final_verdict(spark, sf):
    return screened_model(spark, sf, enrich=False).select("prompt_id", "decision", "score", "is_blocked", "is_flagged")


@register("reason_text", model_sql("SELECT prompt_id, reason FROM screened"))
def q_reason(spark, sf):
    return screened_model(spark, sf, enrich=False).select("prompt_id", "reason")


SCREEN_COLS = ["prompt_id", "normalized_text", "decision", "score", "is_blocked", "is_flagged",
               "matched_pattern", "reason", "status", "risk", "vector", "decision_source", "id"]


@register("screen_prompts", model_sql(f"SELECT {', '.join(SCREEN_COLS)} FROM screened"))
def q_screen(spark, sf):
    return screened_model(spark, sf).select(*SCREEN_COLS)


STEPS = {
    "raw_input": ("phase_1_normalization.raw_input", "text"), "base_score": ("phase_1_normalization.base_score", "base_score"),
    "pipeline_decision": ("phase_1_normalization.pipeline_decision", "pipeline_decision"),
    "arabic_category": ("phase_2_regex.arabic.category", "ar_category"), "english_count": ("phase_2_regex.english.match_count", "en_match_count"),
    "score_after_regex": ("phase_2_regex.score_after_regex", "score_after_regex"), "activated": ("phase_3_ai.activated", "ai_activated"),
    "label": ("phase_3_ai.label", "ai_label"), "decision_after_ai": ("phase_3_ai.decision_after_ai", "decision_after_ai"),
    "final_score": ("final_score", "score"), "final_decision": ("final_decision", "decision")}


@register("pipeline_steps", model_sql("SELECT prompt_id, " + ", ".join(f"{sql} AS {c}" for c, (_, sql) in STEPS.items()) + " FROM screened"))
def q_steps(spark, sf):
    return screened_model(spark, sf, enrich=False).select("prompt_id", *[F.col(f"pipeline_steps.{p}").alias(c) for c, (p, _) in STEPS.items()])


@register("check_prompts", model_sql("SELECT prompt_id, NOT is_flagged AS is_safe FROM screened"))
def q_check(spark, sf):
    return S.check_prompts(screened_model(spark, sf, enrich=False))


@register("policy_switches", pipe_sql("SELECT prompt_id, normalized_text, decision, score FROM screened", rot13=False))
def q_policy(spark, sf):
    return screened(spark, sf, policies=S.Policies(rot13=False), enrich=False).select(
        "prompt_id", "normalized_text", "decision", "score")


def _switched(name: str, columns: str = "prompt_id, normalized_text, decision, score", **off) -> None:
    @register(f"policy_without_{name}", pipe_sql(f"SELECT {columns} FROM screened", **off))
    def q(spark, sf):
        return screened(spark, sf, policies=S.Policies(**off)).selectExpr(*columns.split(", "))


_switched("unicode", unicode_norm=False)
_switched("codecs", base64_hex=False)
_switched("split_letters", split_letter=False)
_switched("franco", "prompt_id, lang_dist.franco AS franco, decision", franco=False)
_switched("any_rewriting", unicode_norm=False, base64_hex=False, split_letter=False, rot13=False, franco=False)


@register("policy_without_model", pipe_sql("SELECT prompt_id, decision, score, ai_activated FROM screened"))
def q_policy_model(spark, sf):
    return screened_model(spark, sf, policies=S.Policies(ai_layer=False), enrich=False).select("prompt_id", "decision", "score", "ai_activated")


# ---------------------------------------------------------------------------
# 2.6 enrichment
# ---------------------------------------------------------------------------
LANG_SQL_COLS = ", ".join(f"lang_dist.{a} AS {a}" for a in fv.LANG_AXES)


@register("classify_language", pipe_sql(f"SELECT prompt_id, {LANG_SQL_COLS} FROM screened"))
def q_language(spark, sf):
    lang = en.classify_language(F.col("text"))
    return prompts(spark, sf).select("prompt_id", *[lang[a].alias(a) for a in fv.LANG_AXES])


@register("classify_vector", model_sql("SELECT prompt_id, matched_pattern, vector FROM screened"))
def q_vector(spark, sf):
    return screened_model(spark, sf).select("prompt_id", "matched_pattern", "vector")


@register("risk_band", model_sql("SELECT prompt_id, score, risk FROM screened"))
def q_risk(spark, sf):
    return screened_model(spark, sf).select("prompt_id", "score", "risk")


@register("decision_source", model_sql("SELECT prompt_id, decision_source FROM screened"))
def q_source(spark, sf):
    return screened_model(spark, sf).select("prompt_id", "decision_source")


@register("status_label", model_sql("SELECT prompt_id, status FROM screened"))
def q_status(spark, sf):
    return screened_model(spark, sf).select("prompt_id", "status")


@register("enrich_verdicts", model_sql(
    "SELECT prompt_id, id, timestamp, status, risk, vector, decision_source FROM screened"))
def q_enrich(spark, sf):
    return screened_model(spark, sf).select("prompt_id", "id", "timestamp", "status", "risk", "vector",
                                            "decision_source")


# ---------------------------------------------------------------------------
# logs: the screened-documents log (model on) and the events log
# ---------------------------------------------------------------------------
from ..operators import analytics as A  # noqa: E402
from ..operators import browse as B  # noqa: E402
from ..operators import review as R  # noqa: E402
from ..operators.quality import detection_quality, mask_pii  # noqa: E402
from ..sources.threat_log import append_threat_log, materialize, read_threat_log  # noqa: E402
from ..operators import model as MD  # noqa: E402
from ..operators import page_index as PI  # noqa: E402
from ..streaming import jobs as J  # noqa: E402
from ..streaming import log_sink as LS  # noqa: E402
from ..streaming import reviews as RV  # noqa: E402
from ..streaming import running as RS  # noqa: E402

LOG_SELECT = ["id", "timestamp", "raw", "normalized_text", "status", "decision", "score", "risk",
              "vector", "ai_confidence", "ai_prediction", "matched_pattern", "lang_dist", "prompt_key"]


def docs_log(spark, sf, *also: str) -> DataFrame:
    """The log, with the columns ``also`` of the screening."""
    log = screened_model(spark, sf).withColumn("raw", F.col("text")).select(*dict.fromkeys((*LOG_SELECT, *also)))
    return materialize(log, "docs_log")


def events_log(spark, sf) -> DataFrame:
    return J.events_log_frame(read_table(spark, sf, "events"))


def combined_log(spark, sf) -> DataFrame:
    return docs_log(spark, sf).unionByName(events_log(spark, sf), allowMissingColumns=True)


DOCS_LOG_CTE = ("SELECT id, timestamp, text AS raw, normalized_text, status, decision, score, risk, vector, "
                "ai_confidence, ai_prediction, matched_pattern, lang_dist, prompt_key FROM screened")
EVENTS_LOG_SQL = (
    "SELECT 'e' || event_id::VARCHAR AS id, ts AS timestamp, props AS raw, props AS normalized_text, "
    "CASE WHEN event_type = 'error' THEN 'BLOCKED' WHEN event_type = 'signup' THEN 'FLAGGED' ELSE 'SAFE' END AS status, "
    "CASE WHEN event_type = 'error' THEN 'BLOCKED' WHEN event_type = 'signup' THEN 'FLAG' ELSE 'SAFE' END AS decision, "
    f"least(floor(value)::INTEGER, {fv.SCORE_CAP}) AS score, user_id, event_type, 'None' AS vector, "
    "NULL::DOUBLE AS ai_confidence, NULL::INTEGER AS ai_prediction FROM events")


def log_sql(select: str) -> str:
    """``select`` runs over views ``docs_log``, ``events_log`` and ``combined_log``."""
    base = O.pipeline_ctes(DOCS, model=PREDICTIONS_SQL, logged_at=LOGGED_AT)
    return (f"WITH {base}, docs_log AS ({DOCS_LOG_CTE}), events_log AS ({EVENTS_LOG_SQL}), "
            f"combined_log AS (SELECT * FROM docs_log UNION ALL BY NAME SELECT * FROM events_log)\n{select}")


def events_sql(select: str) -> str:
    return f"WITH events_log AS ({EVENTS_LOG_SQL})\n{select}"


STATUS_COUNTS = ("count(*) AS total, count_if(upper(coalesce(status, '')) = 'BLOCKED') AS blocked, "
                 "count_if(upper(coalesce(status, '')) = 'FLAGGED') AS flagged, "
                 "count_if(upper(coalesce(status, '')) = 'SAFE') AS safe")


@register("status_counts", log_sql(f"SELECT {STATUS_COUNTS} FROM combined_log"))
def q_status_counts(spark, sf):
    return A.status_counts(combined_log(spark, sf))


@register("status_counts_prompts", pipe_sql(f"SELECT {STATUS_COUNTS} FROM screened", source=CONV))
def q_status_counts_prompts(spark, sf):
    """Flagship: screen the turns of the conversations, count verdicts."""
    return A.status_counts(screened(spark, sf, "conversations"))


@register("threat_rate", log_sql(
    f"SELECT total, blocked, flagged, CASE WHEN total > 0 THEN round_even((blocked + flagged) / total * 100, 1) "
    f"ELSE 0.0 END::DOUBLE AS threat_rate FROM (SELECT {STATUS_COUNTS} FROM combined_log)"))
def q_threat_rate(spark, sf):
    return A.threat_rate(combined_log(spark, sf))


@register("language_distribution", log_sql(
    "SELECT ord, subject, CASE WHEN n > 0 THEN round_even(total / n, 1) ELSE 0.0 END::DOUBLE AS value FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS ord, '{fv.LANG_LABELS[a]}' AS subject, sum(coalesce(lang_dist.{a}, 0.0)) AS total, "
        f"count(*) AS n FROM combined_log" for i, a in enumerate(fv.LANG_AXES)) + ")"))
def q_language_distribution(spark, sf):
    return A.language_distribution(combined_log(spark, sf))


VECTOR_COLOR_SQL = "CASE name " + " ".join(
    f"WHEN {O.lit(k)} THEN {O.lit(v)}" for k, v in fv.VECTOR_COLORS.items()) + f" ELSE {O.lit(fv.VECTOR_COLOR_DEFAULT)} END"
BREAKDOWN_SQL = (f"SELECT name, count, {VECTOR_COLOR_SQL} AS color, first_seen FROM (SELECT vector AS name, "
                 f"count(*) AS count, min(timestamp) AS first_seen FROM combined_log "
                 f"WHERE coalesce(vector, 'None') <> 'None' GROUP BY vector)")


@register("attack_breakdown", log_sql(BREAKDOWN_SQL))
def q_attack_breakdown(spark, sf):
    return A.attack_breakdown(combined_log(spark, sf))


@register("top_vector", log_sql(
    f"SELECT coalesce((SELECT name FROM ({BREAKDOWN_SQL}) ORDER BY count DESC, first_seen, name LIMIT 1), 'None') "
    f"AS top_vector"))
def q_top_vector(spark, sf):
    return A.top_vector(combined_log(spark, sf))


def timeline_sql(view: str, as_of: str, hours: int) -> str:
    slot_min = max(hours * 60 // fv.TIMELINE_SLOTS, 1)
    start = f"(TIMESTAMP '{as_of}' - INTERVAL {hours} HOUR)"
    slot = f"floor((epoch(timestamp) - epoch({start})) / {slot_min * 60})::INTEGER"
    st = "upper(coalesce(status, ''))"
    counted = (f"SELECT slot, count_if({st} = 'BLOCKED') AS blocked, count_if({st} = 'FLAGGED') AS flagged, "
               f"count_if({st} NOT IN ('BLOCKED', 'FLAGGED')) AS safe FROM (SELECT {slot} AS slot, status "
               f"FROM {view} WHERE timestamp IS NOT NULL) WHERE slot >= 0 AND slot < {fv.TIMELINE_SLOTS} GROUP BY slot")
    return (f"SELECT s.slot::INTEGER AS slot, strftime({start} + s.slot * INTERVAL {slot_min} MINUTE, '%H:%M') AS time, "
            f"coalesce(c.blocked, 0) AS blocked, coalesce(c.flagged, 0) AS flagged, coalesce(c.safe, 0) AS safe "
            f"FROM (SELECT range AS slot FROM range({fv.TIMELINE_SLOTS})) s LEFT JOIN ({counted}) c USING (slot)")


@register("timeline", log_sql(timeline_sql("combined_log", "2024-01-31 00:00:00", 720)))
def q_timeline(spark, sf):
    return A.timeline(spark, combined_log(spark, sf), "2024-01-31 00:00:00", 720)


@register("timeline_24h", events_sql(timeline_sql("events_log", "2024-01-15 12:00:00", 24)))
def q_timeline_24h(spark, sf):
    return A.timeline(spark, events_log(spark, sf), "2024-01-15 12:00:00", 24)


DASHBOARD_LISTS = (
    "(SELECT '[' || string_agg('{\"subject\":\"' || subject || '\",\"value\":' || value::VARCHAR || '}', ',' ORDER BY ord) || ']' FROM ("
    "SELECT ord, subject, CASE WHEN n > 0 THEN round_even(total / n, 1) ELSE 0.0 END::DOUBLE AS value FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS ord, '{fv.LANG_LABELS[a]}' AS subject, sum(coalesce(lang_dist.{a}, 0.0)) AS total, "
        f"count(*) AS n FROM combined_log" for i, a in enumerate(fv.LANG_AXES)) + "))) AS language_dist, "
    "(SELECT '[' || coalesce(string_agg('{\"name\":\"' || name || '\",\"count\":' || count || ',\"color\":\"' || color || '\"}', ',' "
    f"ORDER BY count DESC, first_seen, name), '') || ']' FROM ({BREAKDOWN_SQL})) AS attack_breakdown, "
    "(SELECT '[' || string_agg('{\"time\":\"' || time || '\",\"blocked\":' || blocked || ',\"flagged\":' || flagged || ',\"safe\":' || safe || '}', ',' "
    f"ORDER BY slot) || ']' FROM ({timeline_sql('combined_log', '2024-01-31 00:00:00', 720)})) AS timeline")


@register("dashboard_summary", log_sql(
    f"SELECT total AS total_requests, blocked AS total_blocked, flagged AS total_flagged, safe AS total_safe, "
    f"CASE WHEN total > 0 THEN round_even((blocked + flagged) / total * 100, 1) ELSE 0.0 END::DOUBLE AS threat_rate, "
    f"{fv.MODEL_ACCURACY_CONSTANT} AS ai_accuracy, coalesce((SELECT name FROM ({BREAKDOWN_SQL}) "
    f"ORDER BY count DESC, first_seen, name LIMIT 1), 'None') AS top_vector, {DASHBOARD_LISTS} "
    f"FROM (SELECT {STATUS_COUNTS} FROM combined_log)"))
def q_dashboard(spark, sf):
    return A.dashboard_summary(combined_log(spark, sf), "2024-01-31 00:00:00", 720).withColumns(
        {c: F.to_json(c) for c in ("language_dist", "attack_breakdown", "timeline")})


# ---------------------------------------------------------------------------
# 2.8 browsing (events log), review queue, retraining
# ---------------------------------------------------------------------------
@register("log_filter", events_sql("SELECT id, timestamp, status FROM events_log WHERE upper(status) = 'BLOCKED'"))
def q_log_filter(spark, sf):
    return B.log_filter(events_log(spark, sf), "blocked").select("id", "timestamp", "status")


@register("log_date_range", events_sql(
    "SELECT id, timestamp, status FROM events_log WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00' "
    "AND timestamp <= TIMESTAMP '2024-01-12 23:59:59'"))
def q_log_date_range(spark, sf):
    return B.log_date_range(events_log(spark, sf), "2024-01-10 00:00:00", "2024-01-12 23:59:59").select(
        "id", "timestamp", "status")


@register("log_page", events_sql(
    "SELECT rank, id, timestamp, status FROM (SELECT row_number() OVER (ORDER BY timestamp DESC NULLS LAST, id) "
    "AS rank, id, timestamp, status FROM events_log WHERE upper(status) = 'FLAGGED') q WHERE rank > 100 AND rank <= 150"))
def q_log_page(spark, sf):
    return B.log_page(events_log(spark, sf), page=3, page_size=50, status="FLAGGED").select(
        "rank", "id", "timestamp", "status")


@register("log_page_meta", events_sql(
    "SELECT count(*) AS total, greatest(1, ceil(count(*) / 50))::BIGINT AS pages FROM events_log "
    "WHERE upper(status) = 'FLAGGED'"))
def q_log_page_meta(spark, sf):
    return B.log_page_meta(events_log(spark, sf), page_size=50, status="FLAGGED")


@register("log_lookup", events_sql(
    "SELECT id, status, score FROM events_log WHERE id IN (SELECT 'e' || event_id::VARCHAR FROM events "
    "WHERE event_type = 'purchase')"))
def q_log_lookup(spark, sf):
    ids = read_table(spark, sf, "events").filter(F.col("event_type") == "purchase").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"))
    return B.log_lookup(events_log(spark, sf), ids).select("id", "status", "score")


@register("queue_page", log_sql(
    "SELECT rank, id, status, risk, score, 'ALL' AS filter_applied FROM (SELECT row_number() OVER "
    "(ORDER BY timestamp DESC NULLS LAST, id) AS rank, id, coalesce(status, 'SAFE') AS status, "
    "coalesce(risk, CASE WHEN coalesce(score, 0) >= 200 THEN 'CRITICAL' WHEN coalesce(score, 0) >= 120 THEN 'HIGH' "
    "WHEN coalesce(score, 0) >= 80 THEN 'MEDIUM' ELSE 'LOW' END) AS risk, coalesce(score, 0) AS score "
    "FROM combined_log WHERE id IS NOT NULL AND timestamp IS NOT NULL) q WHERE rank > 100 AND rank <= 200"))
def q_queue_page(spark, sf):
    return B.queue_page(combined_log(spark, sf), status="bogus", page=2, page_size=100).select(
        "rank", "id", "status", "risk", "score", "filter_applied")


@register("queue_total", log_sql(
    "SELECT count(*) AS total, 'FLAGGED' AS filter_applied FROM combined_log WHERE id IS NOT NULL AND timestamp IS NOT NULL "
    "AND upper(coalesce(status, 'SAFE')) = 'FLAGGED'"))
def q_queue_total(spark, sf):
    return B.queue_total(combined_log(spark, sf), "flagged")


@register("log_page_deep", events_sql(
    "SELECT rank, id FROM (SELECT row_number() OVER (ORDER BY timestamp DESC NULLS LAST, id) "
    "AS rank, id FROM events_log) q WHERE rank > 4000 AND rank <= 4100"))
def q_log_page_deep(spark, sf):
    """A page far behind the first ones, found by ranges of the order."""
    return B.page_of(events_log(spark, sf), page=41, page_size=100).select("rank", "id")


@register("log_page_indexed", events_sql(
    "SELECT rank, id, status FROM (SELECT row_number() OVER (ORDER BY timestamp DESC NULLS LAST, id) "
    "AS rank, id, status FROM events_log WHERE upper(status) = 'SAFE') q WHERE rank > 3000 AND rank <= 3100"))
def q_log_page_indexed(spark, sf):
    """A deep page of the filtered log, from an index beside it."""
    log = events_log(spark, sf)
    path = PI.build_page_index(log.select("id", "timestamp", "status"), scratch_path(spark, "page-index"), "SAFE", range_rows=1000)
    return PI.indexed_page(spark, path, 31, 100).select("rank", "id", "status")


@register("retain_latest", log_sql(
    f"SELECT id, timestamp, status FROM combined_log ORDER BY timestamp DESC NULLS LAST, id LIMIT {fv.RETAIN_ENTRIES}"))
def q_retain(spark, sf):
    return B.retain_latest(combined_log(spark, sf)).select("id", "timestamp", "status")


@register("latest_feed", log_sql(
    f"SELECT id, timestamp, status FROM combined_log ORDER BY timestamp DESC NULLS LAST, id LIMIT {fv.FEED_ENTRIES}"))
def q_feed(spark, sf):
    return B.latest_feed(combined_log(spark, sf)).select("id", "timestamp", "status")


@register("flagged_count", log_sql(
    f"SELECT count_if(status = 'FLAGGED') AS flagged_count FROM (SELECT status FROM combined_log "
    f"ORDER BY timestamp DESC NULLS LAST, id LIMIT {fv.FEED_ENTRIES})"))
def q_flagged_count(spark, sf):
    return B.flagged_count(B.latest_feed(combined_log(spark, sf)))


def reviews(spark, sf) -> DataFrame:
    return reviews_of(read_table(spark, sf, "labels"))


def reviews_of(lab: DataFrame) -> DataFrame:
    """Reviewer decisions derived from labels: toxic → block, low quality →
    train, else approve; every tenth document gets a later second review
    (train), an invalid action, or a review of an unknown item."""
    item = F.substring(F.sha2(F.concat(F.lit("prompt:d"), F.col("doc_id").cast("string")), 256), 1, 32)
    base_t = F.lit("2024-02-01 00:00:00").cast("timestamp")
    at = base_t + F.make_interval(secs=F.col("doc_id").cast("int"))
    first = lab.select(item.alias("item_id"),
                       F.when(F.col("toxic") == 1, "block").when(F.col("quality") == 0, "train")
                       .otherwise("approve").alias("action"),
                       F.concat(F.lit("note-"), F.col("doc_id").cast("string")).alias("notes"),
                       F.concat(F.lit("reviewer-"), (F.col("doc_id") % 5).cast("string")).alias("reviewer_id"),
                       at.alias("reviewed_at"))
    r = F.col("doc_id") % 10
    second = lab.filter(r.isin(0, 1, 2)).select(
        F.when(r == 2, F.concat(F.lit("missing-"), F.col("doc_id").cast("string"))).otherwise(item).alias("item_id"),
        F.when(r == 1, "escalate").otherwise("train").alias("action"),
        F.lit("second look").alias("notes"), F.lit("reviewer-x").alias("reviewer_id"),
        (at + F.expr("INTERVAL 1 DAY")).alias("reviewed_at"))
    return first.unionByName(second)


REVIEWS_SQL = (
    "SELECT substr(sha256('prompt:d' || doc_id::VARCHAR), 1, 32) AS item_id, CASE WHEN toxic = 1 THEN 'block' "
    "WHEN quality = 0 THEN 'train' ELSE 'approve' END AS action, 'note-' || doc_id::VARCHAR AS notes, "
    "'reviewer-' || (doc_id % 5)::VARCHAR AS reviewer_id, TIMESTAMP '2024-02-01 00:00:00' + to_seconds(doc_id) "
    "AS reviewed_at FROM labels UNION ALL "
    "SELECT CASE WHEN doc_id % 10 = 2 THEN 'missing-' || doc_id::VARCHAR ELSE substr(sha256('prompt:d' || "
    "doc_id::VARCHAR), 1, 32) END, CASE WHEN doc_id % 10 = 1 THEN 'escalate' ELSE 'train' END, 'second look', "
    "'reviewer-x', TIMESTAMP '2024-02-01 00:00:00' + to_seconds(doc_id) + INTERVAL 1 DAY FROM labels "
    "WHERE doc_id % 10 IN (0, 1, 2)")
LATEST_SQL = (f"SELECT item_id, arg_max(action, (reviewed_at, reviewer_id, action, notes)) AS action, "
              f"arg_max(notes, (reviewed_at, reviewer_id, action, notes)) AS notes, "
              f"arg_max(reviewer_id, (reviewed_at, reviewer_id, action, notes)) AS reviewer_id, max(reviewed_at) AS reviewed_at "
              f"FROM ({REVIEWS_SQL}) WHERE action IN ('approve', 'train', 'block') GROUP BY item_id")


def review_sql(select: str) -> str:
    return log_sql(select).replace("\nSELECT", f", reviews AS ({REVIEWS_SQL}), latest AS ({LATEST_SQL})\nSELECT", 1)


MESSAGE_SQL = "CASE action " + " ".join(f"WHEN '{k}' THEN {O.lit(v)}" for k, v in R.MESSAGES.items()) + \
    " ELSE 'Decision recorded.' END"


@register("review_apply", review_sql(
    f"SELECT l.item_id, action, reviewer_id, reviewed_at, 'recorded' AS status, {MESSAGE_SQL} AS message "
    f"FROM latest l JOIN docs_log d ON d.id = l.item_id"))
def q_review_apply(spark, sf):
    return R.review_apply(docs_log(spark, sf), reviews(spark, sf))


@register("stream_review_apply", review_sql(
    f"SELECT l.item_id, action, reviewer_id, reviewed_at, 'recorded' AS status, {MESSAGE_SQL} AS message "
    f"FROM latest l JOIN docs_log d ON d.id = l.item_id"))
def q_stream_review_apply(spark, sf):
    """Reviews meet the log as both arrive."""
    path = scratch_path(spark, "growing-log")
    docs_log(spark, sf).select("id", "timestamp").write.parquet(path)
    entries = spark.readStream.schema("id string, timestamp timestamp").option("maxFilesPerTrigger", 8).parquet(path)
    told = RV.stream_reviews(entries, reviews_of(J.read_stream_table(spark, sf, "labels")))
    return RV.recorded_reviews(J.run_once(told, "stream_reviews"))


@register("review_rejected", review_sql(
    "SELECT item_id, action, reject_reason FROM (SELECT item_id, action, 'invalid_action' AS reject_reason "
    "FROM reviews WHERE action NOT IN ('approve', 'train', 'block') UNION ALL SELECT item_id, action, 'not_found' "
    "FROM reviews WHERE action IN ('approve', 'train', 'block') AND item_id NOT IN (SELECT id FROM docs_log))"))
def q_review_rejected(spark, sf):
    return R.rejected_reviews(docs_log(spark, sf), reviews(spark, sf)).select("item_id", "action", "reject_reason")


@register("queue_open", review_sql(
    "SELECT id, status FROM docs_log WHERE id NOT IN (SELECT item_id FROM latest)"))
def q_queue_open(spark, sf):
    return R.queue_open(docs_log(spark, sf), reviews(spark, sf)).select("id", "status")


@register("allow_block_lists", review_sql(
    "SELECT CASE WHEN action = 'approve' THEN 'allow' ELSE 'block' END AS list, sha256(normalized_text) AS text_hash, "
    "l.item_id, normalized_text FROM latest l JOIN docs_log d ON d.id = l.item_id WHERE action IN ('approve', 'block')"))
def q_lists(spark, sf):
    return R.allow_block_lists(docs_log(spark, sf), reviews(spark, sf))


@register("apply_lists", review_sql(
    "SELECT id, decision, list_decision FROM (SELECT d.id, d.decision, CASE WHEN k.list = 'block' THEN 'BLOCKED' WHEN k.list = 'allow' "
    "THEN 'SAFE' ELSE d.decision END AS list_decision FROM docs_log d LEFT JOIN (SELECT text_hash, max(list) AS list FROM ("
    "SELECT CASE WHEN action = 'approve' THEN 'allow' ELSE 'block' END AS list, sha256(normalized_text) AS text_hash "
    "FROM latest l JOIN docs_log e ON e.id = l.item_id WHERE action IN ('approve', 'block')) GROUP BY text_hash) k "
    "ON k.text_hash = sha256(d.normalized_text))"))
def q_apply_lists(spark, sf):
    log = docs_log(spark, sf)
    lists = R.allow_block_lists(log, reviews(spark, sf))
    return R.apply_lists(log.withColumn("prompt_id", F.col("id")), lists).select("id", "decision", "list_decision")


RETRAIN_SAVED_AT = "2024-02-05T00:00:00+00:00"


@register("build_retraining", review_sql(
    "SELECT d.id, coalesce(raw, '') AS text, coalesce(normalized_text, '') AS normalized_text, 1 AS label, score, "
    "CASE WHEN ai_prediction = 1 THEN floor(coalesce(ai_confidence, 0.0) * 300)::INTEGER ELSE 0 END AS ai_score, "
    "ai_confidence, ai_prediction, coalesce(vector, 'None') AS vector, 'unknown' AS dialect, "
    "'Unknown / Semantic attack' AS intent_goal, coalesce(notes, '') AS notes, "
    f"'{RETRAIN_SAVED_AT}' AS saved_at FROM latest l JOIN docs_log d ON d.id = l.item_id WHERE action = 'train'"))
def q_retraining(spark, sf):
    return R.build_retraining(docs_log(spark, sf), reviews(spark, sf), RETRAIN_SAVED_AT)


# ---------------------------------------------------------------------------
# 2.9 policy, masking, quality
# ---------------------------------------------------------------------------
PII_SQL = [("NATIONAL_ID", "[23][0-9]{13}", True), ("PHONE", "01[0125][0-9]{8}", True),
           ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", False),
           ("PASSWORD", r"(?i)password(?:[:=] ?| is )[^ \t\r\n]+", False)]


def _pii_sql(t: str) -> tuple[str, dict[str, str]]:
    """(masked text, counts): numbers are whole runs of digits that match."""
    counts = {}
    for kind, pat, number in PII_SQL:
        if number:
            runs = f"regexp_extract_all({t}, '[0-9]+|[^0-9]+', 0)"
            is_one = f"regexp_full_match(r, {O.lit(pat)})"
            counts[kind] = f"len(list_filter({runs}, lambda r: {is_one}))"
            t = f"coalesce(array_to_string(list_transform({runs}, lambda r: CASE WHEN {is_one} THEN '[REDACTED:{kind}]' ELSE r END), ''), '')"
        elif kind == "PASSWORD":
            counts[kind] = f"len(regexp_extract_all({t}, {O.lit(pat)}, 0))"
            t = f"regexp_replace({t}, {O.lit('(?i)(password(?:[:=] ?| is ))[^ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n]+')}, '\\1[REDACTED:PASSWORD]', 'g')"
        else:
            counts[kind] = f"len(regexp_extract_all({t}, {O.lit(pat)}, 0))"
            t = f"regexp_replace({t}, {O.lit(pat)}, '[REDACTED:{kind}]', 'g')"
    return t, counts


_MASKED, _COUNTS = _pii_sql("text")


@register("mask_pii", f"SELECT prompt_id, {_MASKED} AS masked_text FROM ({DOCS})")
def q_mask(spark, sf):
    masked, _ = mask_pii(F.col("text"))
    return prompts(spark, sf).select("prompt_id", masked.alias("masked_text"))


@register("pii_counts", "SELECT " + ", ".join(f"sum({e})::BIGINT AS n_{k.lower()}" for k, e in _COUNTS.items()) + f" FROM ({DOCS})")
def q_pii_counts(spark, sf):
    _, counts = mask_pii(F.col("text"))
    return prompts(spark, sf).agg(*[F.sum(c).alias(f"n_{k.lower()}") for k, c in counts.items()])


@register("detection_quality", model_sql(
    "SELECT tp, fp, tn, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, "
    "round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, "
    "round(CASE WHEN tp + fp > 0 AND tp + fn > 0 AND tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM ("
    "SELECT count_if(is_flagged AND toxic = 1) AS tp, count_if(is_flagged AND toxic <> 1) AS fp, "
    "count_if(NOT is_flagged AND toxic <> 1) AS tn, count_if(NOT is_flagged AND toxic = 1) AS fn "
    "FROM screened s JOIN labels l ON l.doc_id = s.prompt_key)"))
def q_quality(spark, sf):
    """Only labelled prompts are screened: a semi-join before the screening."""
    labels = read_table(spark, sf, "labels")
    labelled = prompts(spark, sf).join(labels.select(F.col("doc_id").alias("prompt_key")).distinct(), "prompt_key", "left_semi")
    out = S.screen_prompts(labelled, pack(spark), model=predictions(spark, sf), logged_at=LOGGED_AT, enrich=False)
    return detection_quality(out, labels)


# ---------------------------------------------------------------------------
# 2.1 log storage round trip, 2.10 streaming
# ---------------------------------------------------------------------------
@register("read_threat_log", pipe_sql(
    "SELECT id, status, score, vector, decision, base_score FROM screened", source=CONV))
def q_read_log(spark, sf):
    path = scratch_path(spark, "threat_log")
    log = S.to_log(screened(spark, sf, "conversations"))
    append_threat_log(log, path)
    return read_threat_log(spark, path).select("id", "status", "score", "vector", "decision", "base_score")


@register("stream_screen", pipe_sql("SELECT prompt_id, decision, score, status, vector FROM screened"))
def q_stream_screen(spark, sf):
    s = J.stream_screen(spark, sf, pack(spark), "documents", logged_at=LOGGED_AT)
    return J.run_once(s.select("prompt_id", "decision", "score", "status", "vector"), "stream_screen")


@register("stream_latest", events_sql(
    f"SELECT id, timestamp, status FROM events_log ORDER BY timestamp DESC NULLS LAST, id LIMIT {fv.FEED_ENTRIES}"))
def q_stream_latest(spark, sf):
    """The feed as running state: bounded per shard, merged when it is read."""
    told = J.run_once(RS.stream_latest(J.events_log_frame(J.read_stream_table(spark, sf, "events")), fv.FEED_ENTRIES), "stream_latest", mode="update")
    return RS.latest_of(told, fv.FEED_ENTRIES).select("id", "timestamp", "status")


@register("stream_counters", pipe_sql(
    "SELECT vector, count(*) AS n, " + ", ".join(f"sum(coalesce(lang_dist.{a}, 0.0)) AS {a}_sum" for a in fv.LANG_AXES) + " FROM screened GROUP BY vector"))
def q_stream_counters(spark, sf):
    s = J.stream_screen(spark, sf, pack(spark), "documents", logged_at=LOGGED_AT)
    return RS.newest_version(J.run_once(J.stream_counters(s), "stream_counters", mode="update"), ["vector"])


def stream_timeline_sql(as_of: str, hours: int) -> str:
    slot_min = max(hours * 60 // fv.TIMELINE_SLOTS, 1)
    start = f"(TIMESTAMP '{as_of}' - INTERVAL {hours} HOUR)"
    slot = f"floor((epoch(timestamp) - epoch({start})) / {slot_min * 60})::INTEGER"
    st = "upper(coalesce(status, ''))"
    return events_sql(
        f"SELECT {start} + slot * INTERVAL {slot_min} MINUTE AS slot_start, count_if({st} = 'BLOCKED') AS blocked, "
        f"count_if({st} = 'FLAGGED') AS flagged, count_if({st} NOT IN ('BLOCKED', 'FLAGGED')) AS safe FROM "
        f"(SELECT {slot} AS slot, status FROM events_log) WHERE slot >= 0 AND slot < {fv.TIMELINE_SLOTS} GROUP BY slot")


@register("stream_timeline", stream_timeline_sql("2024-01-31 00:00:00", 720))
def q_stream_timeline(spark, sf):
    ev = J.read_stream_table(spark, sf, "events")
    res = J.run_once(J.stream_timeline(ev, "2024-01-31 00:00:00", 720, lateness="1 day"), "stream_timeline", mode="update")
    latest = res.groupBy("w").agg(F.max(F.struct("epoch", "blocked", "flagged", "safe")).alias("x")).select("w", "x.blocked", "x.flagged", "x.safe")
    return J.timeline_slots(latest, "2024-01-31 00:00:00", 720)


@register("stream_timeline_late", events_sql(
    "SELECT time_bucket(INTERVAL 6 HOUR, timestamp) AS slot_start, count_if(status = 'BLOCKED') AS blocked, count_if(status = 'FLAGGED') AS flagged, "
    "count_if(status NOT IN ('BLOCKED', 'FLAGGED')) AS safe FROM events_log WHERE timestamp IS NOT NULL GROUP BY 1"))
def q_stream_timeline_late(spark, sf):
    """Counts of the slots and the rows that came too late for theirs, together."""
    path = scratch_path(spark, "slots")
    log = J.events_log_frame(J.read_stream_table(spark, sf, "events")).select("id", "timestamp", "status")
    RS.append_slots(log, path, scratch_path(spark, "slots-checkpoint"), "6 hours", "1 day").awaitTermination()
    st = F.col("status")
    late = RS.late_rows(spark, path).where("timestamp is not null").groupBy(F.window("timestamp", "6 hours").start.alias("slot_start")).agg(
        F.count_if(st == "BLOCKED").alias("blocked"), F.count_if(st == "FLAGGED").alias("flagged"), F.count_if(~st.isin("BLOCKED", "FLAGGED")).alias("safe"))
    return RS.slots(spark, path).unionByName(late).groupBy("slot_start").agg(*[F.sum(c).alias(c) for c in ("blocked", "flagged", "safe")])


@register("read_threat_log_quarantine", events_sql(
    "SELECT id LIKE '%7' AS quarantined, count(*) AS n, count(DISTINCT CASE WHEN id NOT LIKE '%7' THEN status END) AS statuses FROM events_log GROUP BY 1"))
def q_read_quarantine(spark, sf):
    """A log with damaged lines (every id that ends in 7 is cut off): what can
    be read is read, the rest is kept as it is."""
    path = scratch_path(spark, "damaged-log")
    line = F.to_json(F.struct("id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "status", "score"))
    events_log(spark, sf).select(F.when(F.col("id").endswith("7"), F.substring(line, 1, 30)).otherwise(line).alias("value")).write.text(path)
    log = materialize(read_threat_log(spark, path, quarantine=True).select("id", "status", "_corrupt_record"), "quarantine")
    bad = F.col("_corrupt_record").isNotNull()
    return log.groupBy(bad.alias("quarantined")).agg(F.count("*").alias("n"), F.countDistinct(F.when(~bad, F.col("status"))).alias("statuses"))


@register("stream_append_log", events_sql(
    "SELECT id, status, score, CAST(timestamp AS DATE) AS dt FROM events_log WHERE CAST(timestamp AS DATE) = DATE '2024-01-11'"))
def q_stream_append_log(spark, sf):
    """Events are appended by a stream, the batches merged, and one day read."""
    path = scratch_path(spark, "stream-log")
    log = J.events_log_frame(J.read_stream_table(spark, sf, "events")).select("id", "timestamp", "status", "score")
    LS.append_stream(log, path, scratch_path(spark, "stream-log-checkpoint")).awaitTermination()
    LS.compact(spark, path)
    return LS.read_log(spark, path).where("dt = DATE '2024-01-11'").select("id", "status", "score", "dt")


@register("stream_dedupe", "SELECT DISTINCT user_id, event_type, props FROM events")
def q_stream_dedupe(spark, sf):
    ev = J.read_stream_table(spark, sf, "events")
    keys = ["user_id", "event_type", "props"]
    return J.run_once(J.stream_dedupe(ev, keys, watermark="60 days").select(*keys), "stream_dedupe")


@register("append_threat_log", pipe_sql(
    "SELECT id, status, score, CAST(timestamp AS DATE) AS dt FROM screened", source=CONV))
def q_append_log(spark, sf):
    """Append the screened conversation log as day-partitioned parquet, then
    read one day back (partition pruning on ``dt``)."""
    path = scratch_path(spark, "threat_log_parquet")
    append_threat_log(S.to_log(screened(spark, sf, "conversations")), path, fmt="parquet")
    append_threat_log(S.to_log(screened(spark, sf, "conversations", logged_at="2024-01-29 12:00:00")), path, fmt="parquet")
    back = spark.read.parquet(path).filter(F.col("dt") == F.lit(LOGGED_AT[:10]).cast("date"))
    return back.select("id", "status", "score", "dt")


@register("read_retraining", review_sql(
    "SELECT d.id, 1 AS label, score, coalesce(vector, 'None') AS vector, coalesce(notes, '') AS notes "
    "FROM latest l JOIN docs_log d ON d.id = l.item_id WHERE action = 'train'"))
def q_retraining_roundtrip(spark, sf):
    """build_retraining → append JSON lines → read back with the nullable
    retraining schema."""
    from ..sources.threat_log import append_retraining, read_retraining
    path = scratch_path(spark, "retraining")
    append_retraining(R.build_retraining(docs_log(spark, sf), reviews(spark, sf), RETRAIN_SAVED_AT), path)
    return read_retraining(spark, path).select("id", "label", "score", "vector", "notes")
