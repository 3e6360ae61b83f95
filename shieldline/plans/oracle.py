"""DuckDB oracle SQL for the registered queries.

An independent formulation of every stage for RE2 (no look-arounds, no
back-references) and DuckDB list lambdas, used by the correctness gate to
cross-check the Spark plans on the same parquet tables.  Where Python's
``\\b`` is needed a consuming group stands in for it; repetition collapse and
single-letter runs are evaluated on character / segment lists with bounded
neighbour look-ups.

Known limits of the oracle (documented, not hidden): DuckDB has no NFKC, so
NFKC is NFC plus a table of the compatibility characters that the seeded texts
hold; HTML unescaping covers the XML entities plus the named entities found in
the given ``pages`` table.
"""

from __future__ import annotations

from .. import fixed_values as fv
from ..functions import normalize as nz
from ..functions.regex import NOT_WORD, SPACE, SPACE_CHARS, WORD, WORD_CHARS, portable
from ..functions.scoring import FOLDED_PHRASES
from ..sources.prompts import SEED_MODULUS, SEED_PAYLOADS
from ..sources.rules_source import default_rule_rows


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(items) -> str:
    return "[" + ", ".join(lit(x) for x in items) + "]"


def rx(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


def count_rx(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {lit(pattern)}, 0))"


def replace_rx(text: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(repl)}, 'g')"


# ---------------------------------------------------------------------------
# sources
# ---------------------------------------------------------------------------


def seeded(text: str, key: str) -> str:
    return f"concat_ws(' ', {text}, {str_list(SEED_PAYLOADS)}[({key}) % {SEED_MODULUS} + 1])"


def prompts_sql(source: str = "conversations") -> str:
    if source == "conversations":
        key = "conv_id * 31 + turn"
        return (f"SELECT 'c' || conv_id::VARCHAR || '-' || turn::VARCHAR AS prompt_id, {key} AS prompt_key, "
                f"{seeded('text::VARCHAR', key)} AS text FROM conversations")
    if source == "documents":
        return (f"SELECT 'd' || doc_id::VARCHAR AS prompt_id, doc_id AS prompt_key, "
                f"{seeded('text::VARCHAR', 'doc_id')} AS text FROM documents")
    raise ValueError(source)


# ---------------------------------------------------------------------------
# normalisation stages (each maps a SQL text expression to one)
# ---------------------------------------------------------------------------
RE2_EVIL_COUNT = r"(?i)([\p{L}\p{N}_]?)(?:exploit|bypass|leak|reveal)[A-Za-z]*" + SPACE + r"*\("


def replace_all(t: str, found: str, token: str) -> str:
    """Every occurrence of each of the found literals, one literal after another."""
    return f"list_reduce(list_concat([{t}], {found}), lambda acc, m: replace(acc, m, {lit(token)}))"


def intent_signals(raw: str) -> dict[str, str]:
    return {
        "loop": f"({rx(raw, nz.RX_LOOP)} AND {rx(raw, nz.RX_LOOP_WORD)})",
        "n_console": count_rx(raw, nz.RX_CONSOLE),
        "n_evil": f"len(list_filter(regexp_extract_all({raw}, {lit(RE2_EVIL_COUNT)}, 1), lambda g: g = ''))",
        "classic": rx(raw, nz.RX_CLASSIC),
    }


def intent_score(raw: str) -> str:
    s = intent_signals(raw)
    return (f"(CASE WHEN {s['loop']} THEN {fv.W_INFINITE_LOOP} ELSE 0 END + {s['n_console']} * {fv.W_CONSOLE_LEAK}"
            f" + {s['n_evil']} * {fv.W_EVIL_CALL} + CASE WHEN {s['classic']} THEN {fv.W_CLASSIC_PHRASE} ELSE 0 END)")


def intent_rewrite(raw: str) -> str:
    s = intent_signals(raw)
    t = f"CASE WHEN {s['loop']} THEN {replace_rx(raw, nz.RX_LOOP_BODY, fv.TOKEN_INFINITE_LOOP)} ELSE {raw} END"
    t = replace_all(t, f"regexp_extract_all({raw}, {lit(nz.RX_CONSOLE)}, 0)", fv.TOKEN_DATA_LEAK)
    calls = (f"list_filter(regexp_extract_all({raw}, {lit(RE2_EVIL_COUNT)}, 0), "
             f"lambda m, i: regexp_extract_all({raw}, {lit(RE2_EVIL_COUNT)}, 1)[i] = '')")
    t = replace_all(t, calls, fv.TOKEN_EVIL_CALL)
    t = replace_rx(t, nz.RX_CLASSIC, fv.TOKEN_JAILBREAK)
    return py_strip(t)


def py_strip(t: str) -> str:
    return replace_rx(t, f"^{SPACE}+|{SPACE}+$", "")


XML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "\u00a9"),
                ("&middot;", "\u00b7"), ("&amp;", "&")]


def html_unescape(t: str) -> str:
    for ent, ch in XML_ENTITIES:
        t = f"replace({t}, {lit(ent)}, {lit(ch)})"
    return t


# What NFKC makes of the compatibility characters that the seeded texts hold.
NFKC_TABLE = [("\uff49", "i"), ("\uff47", "g"), ("\uff4e", "n"), ("\uff4f", "o"), ("\uff52", "r"), ("\uff45", "e"),
              ("\ufb01", "fi"), ("\u2460", "1"), ("\u2461", "2")]


def nfkc(t: str) -> str:
    t = f"nfc_normalize({t})"
    for a, b in NFKC_TABLE:
        t = f"replace({t}, {lit(a)}, {lit(b)})"
    return t


def strip_tags(t: str) -> str:
    return replace_rx(t, fv.RE_HTML_TAG, "")


def arabic_fold(t: str) -> str:
    return f"translate({replace_rx(t, fv.ARABIC_DIACRITICS, '')}, {lit(fv.ARABIC_FOLD_FROM)}, {lit(fv.ARABIC_FOLD_TO)})"


def drop_emoji(t: str) -> str:
    return replace_rx(t, nz.RX_EMOJI, "")


PRINTABLE = r"[\x{20}-\x{7E}]+"


def decode_base64_runs(t: str) -> str:
    group = "=*[A-Za-z0-9+/]=*[A-Za-z0-9+/]"
    whole = f"^((?:{group}=?[A-Za-z0-9+/][A-Za-z0-9+/])*)(?:({group})==|({group}=?[A-Za-z0-9+/])=|=*$)"
    filled = "rpad(s, (((length(s) + 3) // 4) * 4)::INTEGER, '=')"
    data = (f"replace(concat(regexp_extract({filled}, {lit(whole)}, 1), regexp_extract({filled}, {lit(whole)}, 2), "
            f"regexp_extract({filled}, {lit(whole)}, 3)), '=', '')")
    padded = f"rpad({data}, (((length({data}) + 3) // 4) * 4)::INTEGER, '=')"
    dec = f"try(decode(from_base64({padded})))"
    ok = (f"length(s) >= 12 AND regexp_full_match(s, '[A-Za-z0-9+/=]+') AND regexp_matches({filled}, {lit(whole)}) "
          f"AND regexp_full_match(coalesce({dec}, ''), {lit(PRINTABLE)})")
    return (f"array_to_string(list_transform(regexp_extract_all({t}, '[A-Za-z0-9+/=]+|[^A-Za-z0-9+/=]+', 0), "
            f"lambda s: CASE WHEN {ok} THEN {dec} ELSE s END), '')")


def decode_hex_runs(t: str) -> str:
    dec = "try(decode(unhex(s)))"
    ok = (f"regexp_full_match(s, '[0-9a-fA-F]{{8,}}') AND length(s) % 2 = 0 "
          f"AND regexp_full_match(coalesce({dec}, ''), {lit(PRINTABLE)})")
    return (f"array_to_string(list_transform(regexp_extract_all({t}, {lit(nz.RX_WORD_SEGMENTS)}, 0), "
            f"lambda s: CASE WHEN {ok} THEN {dec} ELSE s END), '')")


def deobfuscate_tokens(t: str, use_rot13: bool = True, mode: str = "full", lexicon: str | None = None) -> str:
    """``lexicon``: an SQL list in place of the built-in one."""
    rot_on, conf_on = nz.TOKEN_MODES[mode]
    rot_on = rot_on and use_rot13
    lex = lexicon or str_list(fv.LEXICON)
    rot = f"translate(tok, {lit(nz._ASCII)}, {lit(nz._ROT13)})"
    chosen = (f"CASE WHEN list_contains({lex}, lower({rot})) AND NOT list_contains({lex}, lower(tok)) "
              f"THEN {rot} ELSE tok END") if rot_on else "tok"
    mapped = f"translate(lower({chosen}), {lit(nz.CONF_FROM)}, {lit(nz.CONF_TO)})" if conf_on else chosen
    toks = f"regexp_extract_all({t}, {lit(nz.RX_TOKENS)}, 0)"
    if rot_on or conf_on:
        deob = f"CASE WHEN regexp_matches(tok, {lit(fv.DEOBFUSCATION_GATE)}) THEN {mapped} ELSE tok END"
        toks = f"list_transform({toks}, lambda tok: {deob})"
    spaced = f"list_transform({toks}, lambda x: CASE WHEN regexp_full_match(x, '[\\p{{L}}\\p{{N}}]+') THEN x || ' ' ELSE x END)"
    return f"rtrim(array_to_string({spaced}, ''), ' ')"


_LETTER = r"[\p{L}\p{N}_\x{0600}-\x{06FF}]"
_SEP = f"[{SPACE_CHARS}\\-_]"
RE2_SPLIT_RUN = f"(^|{SPACE})((?:{_LETTER}{_SEP}+){{2,}}{_LETTER})({SPACE}|$)"


def merge_split_letters_pass1(t: str) -> str:
    merged = (f"list_transform(regexp_extract_all({t}, {lit(RE2_SPLIT_RUN)}, 0), lambda m: "
              f"regexp_extract(m, {lit('^' + SPACE)}, 0) || {replace_rx('m', _SEP, '')} || "
              f"regexp_extract(m, {lit(SPACE + '$')}, 0))")
    parts = f"string_split_regex({t}, {lit(RE2_SPLIT_RUN)})"
    return (f"(SELECT array_to_string(list_transform(pp, lambda p, i: p || coalesce(mm[i], '')), '') "
            f"FROM (SELECT {parts} AS pp, {merged} AS mm))")


def merge_split_letters_pass2(t: str) -> str:
    def at(j: str) -> str:
        return f"(CASE WHEN {j} >= 1 THEN segs[{j}] END)"

    def single(j: str) -> str:
        return f"coalesce(regexp_full_match({at(j)}, '[A-Za-z0-9]'), false)"

    def sp(j: str) -> str:
        return f"coalesce(regexp_full_match({at(j)}, {lit(SPACE)}), false)"

    def tri(j: str) -> str:
        return f"({single(j)} AND {sp(f'{j}+1')} AND {single(f'{j}+2')} AND {sp(f'{j}+3')} AND {single(f'{j}+4')})"

    def inrun(i: str) -> str:
        return f"({single(i)} AND ({tri(i)} OR {tri(f'{i}-2')} OR {tri(f'{i}-4')}))"

    seg_rx = f"{WORD}+|[^{WORD_CHARS}]"
    return (f"(SELECT array_to_string(list_filter(segs, lambda x, i: NOT ({sp('i')} AND {inrun('i-1')})), '') "
            f"FROM (SELECT regexp_extract_all({t}, {lit(seg_rx)}, 0) AS segs))")


def _repeat_flags(chars_col: str) -> tuple:
    def at(j: str) -> str:
        return f"(CASE WHEN {j} >= 1 THEN {chars_col}[{j}] END)"

    def eq4(j: str) -> str:
        return (f"coalesce({at(j)} <> chr(10) AND {at(j)} = {at(f'{j}+1')} AND {at(f'{j}+1')} = {at(f'{j}+2')} "
                f"AND {at(f'{j}+2')} = {at(f'{j}+3')}, false)")
    return at, eq4


def collapse_repeats(t: str) -> str:
    at, eq4 = _repeat_flags("chars")
    drop = (f"coalesce({at('i')} = {at('i-1')}, false) AND "
            f"({eq4('i-3')} OR {eq4('i-2')} OR {eq4('i-1')} OR {eq4('i')})")
    return (f"(SELECT array_to_string(list_filter(chars, lambda c, i: NOT ({drop})), '') "
            f"FROM (SELECT string_split({t}, '') AS chars))")


def has_repeat(t: str) -> str:
    _, eq4 = _repeat_flags("chars")
    return (f"(SELECT coalesce(list_bool_or(list_transform(chars, lambda c, i: {eq4('i')})), false) "
            f"FROM (SELECT string_split({t}, '') AS chars))")


# ---------------------------------------------------------------------------
# the pipeline as a CTE chain over a prompts relation (prompt_id, text)
# ---------------------------------------------------------------------------
RE2_FLAG_HEX = f"(^|{NOT_WORD})[0-9a-fA-F]{{8,}}($|{NOT_WORD})"
RE2_FLAG_SPLIT = f"(^|{NOT_WORD})[A-Za-z]{SPACE}+[A-Za-z]{SPACE}+[A-Za-z]{SPACE}+"
RE2_BENIGN = "(?i)(^|[^\\p{L}\\p{N}_])(?:" + "|".join(fv.BENIGN_CODE_WORDS) + ")($|[^\\p{L}\\p{N}_])"
RE2_FRANCO = (f"(^|{NOT_WORD})[a-zA-Z{fv.FRANCO_DIGITS}]*[{fv.FRANCO_DIGITS}][a-zA-Z{fv.FRANCO_DIGITS}]*($|{NOT_WORD})")
RE2_FRANCO_WORDS = f"(?i)(^|{NOT_WORD})(?:" + "|".join(fv.FRANCO_WORDS) + f")($|{NOT_WORD})"


def rules_rows():
    return [dict(zip(["rule_id", "layer", "grp", "category", "ord", "anchors", "pattern", "enabled"], r))
            for r in default_rule_rows()]


def _rule_cond(norm: str, r: dict) -> str:
    return f"regexp_matches({norm}, {lit('(?is)' + portable(r['pattern']))})"


def layer_hits(norm: str, layer: str) -> str:
    items = [f"CASE WHEN {_rule_cond(norm, r)} THEN {lit(r['rule_id'])} END"
             for r in rules_rows() if r["layer"] == layer]
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def rule_attr(rule_id: str, attr: str) -> str:
    whens = " ".join(f"WHEN {lit(r['rule_id'])} THEN {lit(r[attr])}" for r in rules_rows())
    return f"(CASE {rule_id} {whens} END)"


def truncate(c: str, n: int) -> str:
    return f"(CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '…' ELSE {c} END)"


def pipeline_ctes(prompts: str, *, model: str | None = None, threshold: int | None = None,
                  strict: bool = False, logged_at: str = "2024-01-31 00:00:00",
                  source: str = "prompt", rot13: bool = True, unicode_norm: bool = True, base64_hex: bool = True,
                  split_letter: bool = True, franco: bool = True, lexicon: str | None = None,
                  phrases_in: str | None = None, keywords_in: str | None = None) -> str:
    """CTEs p0..p9 ending in ``screened``.  ``model`` is an optional SQL
    relation (prompt_id, ai_prediction, ai_confidence); ``lexicon``,
    ``phrases_in`` and ``keywords_in`` are relations (word or phrase) in place
    of the built-in lists; the switches are those of ``Policies``."""
    raw = "text"
    code = " + ".join(f"CASE WHEN {rx(raw, '(?i)' + portable(p))} THEN {fv.W_CODE_PATTERN} ELSE 0 END"
                      for p in fv.CODE_PATTERNS)
    code_sql = f"(CASE WHEN ({code}) = 0 AND {rx(raw, RE2_BENIGN)} THEN {fv.W_BENIGN_CODE} ELSE ({code}) END)"
    folded = arabic_fold(raw)
    phrases = " + ".join(f"CASE WHEN contains({folded}, {lit(p)}) THEN {fv.W_ARABIC_PHRASE} ELSE 0 END"
                         for p in FOLDED_PHRASES)
    if phrases_in:
        phrases = f"(SELECT count(*) FROM ({phrases_in}) ph WHERE contains({folded}, ph.phrase)) * {fv.W_ARABIC_PHRASE}"
    known = "_keywords" if keywords_in else str_list(fv.DANGEROUS_KEYWORDS)
    kw = (f"len(list_filter(regexp_extract_all(lower(normalized_text), {lit(WORD + '+')}, 0), "
          f"lambda w: list_contains({known}, w))) * {fv.W_KEYWORD}")
    lists = "".join(f", (SELECT list(DISTINCT lower(word)) FROM ({rel})) AS {name}"
                    for rel, name in ((lexicon, "_lexicon"), (keywords_in, "_keywords")) if rel)
    compat = nfkc("intent_text") if unicode_norm else "intent_text"
    decoded = drop_emoji(arabic_fold(strip_tags(html_unescape(compat))))
    if base64_hex:
        decoded = decode_hex_runs(decode_base64_runs(decoded))
    deobfuscated = deobfuscate_tokens("t9", rot13, "full" if unicode_norm else "rot13", "_lexicon" if lexicon else None)
    merged = merge_split_letters_pass2(merge_split_letters_pass1("t10")) if split_letter else "t10"
    decision = (f"CASE WHEN base_score >= {fv.THRESHOLD_BLOCKED} THEN 'BLOCKED' "
                f"WHEN base_score >= {fv.THRESHOLD_FLAG} THEN 'FLAG' ELSE 'SAFE' END")
    if threshold is not None and threshold != fv.THRESHOLD_BLOCKED:
        decision = (f"CASE WHEN base_score >= {threshold} THEN 'BLOCKED' WHEN ({decision}) = 'BLOCKED' "
                    f"THEN 'FLAG' ELSE ({decision}) END")
    gate = ("(score_after_regex BETWEEN 80 AND 120 OR decision_after_regex IN ('FLAG', 'BLOCKED'))"
            if model else "false")
    if model:
        ai = (f"p7 AS (SELECT p6.*, {gate} AS ai_activated FROM p6), "
              f"p8 AS (SELECT p7.*, CASE WHEN ai_activated THEN m.ai_prediction END::INTEGER AS ai_prediction, "
              f"CASE WHEN ai_activated THEN m.ai_confidence END::DOUBLE AS ai_confidence "
              f"FROM p7 LEFT JOIN ({model}) m USING (prompt_id)), ")
    else:
        ai = ("p7 AS (SELECT p6.*, false AS ai_activated FROM p6), "
              "p8 AS (SELECT p7.*, NULL::INTEGER AS ai_prediction, NULL::DOUBLE AS ai_confidence FROM p7), ")
    block = f"ai_activated AND ai_prediction = 1 AND ai_confidence >= {fv.AI_BLOCK_CONF}"
    flag = (f"ai_activated AND ai_prediction = 1 AND ai_confidence < {fv.AI_BLOCK_CONF} AND "
            f"ai_confidence >= {fv.AI_FLAG_CONF} AND decision_after_regex = 'SAFE'")
    unflag = (f"ai_activated AND coalesce(ai_prediction, -1) <> 1 AND decision_after_regex = 'FLAG' "
              f"AND ai_confidence < {fv.AI_SAFE_CONF}")
    after_ai = f"""p9 AS (SELECT p8.*,
        (CASE WHEN {block} THEN greatest(score_after_regex, {fv.AI_BLOCK_SCORE})
              WHEN {flag} THEN greatest(score_after_regex, {fv.AI_FLAG_SCORE})
              WHEN {unflag} THEN least(score_after_regex, {fv.AI_SAFE_SCORE_CAP})
              ELSE score_after_regex END)::INTEGER AS score_after_ai,
        CASE WHEN {block} THEN 'BLOCKED' WHEN {flag} THEN 'FLAG' WHEN {unflag} THEN 'SAFE'
             ELSE decision_after_regex END AS decision_after_ai,
        CASE WHEN ai_prediction = 1 THEN 'MALICIOUS' WHEN ai_prediction = 0 THEN 'SAFE' END AS ai_label
      FROM p8)"""
    final_dec = ("CASE WHEN decision_after_ai = 'FLAG' THEN 'BLOCKED' ELSE decision_after_ai END"
                 if strict else "decision_after_ai")

    def conf2(c):
        return f"printf('%.2f', round(round({c}, 4), 2))"

    def part(cond, *pieces):
        return f"CASE WHEN {cond} THEN concat({', '.join(pieces)}) END"

    reason = f"""CASE WHEN decision = 'SAFE' THEN concat('No threats detected (score=', score::VARCHAR, '/300).',
            CASE WHEN ai_activated AND ai_label = 'SAFE' THEN concat(' AI confirms safe (confidence=', {conf2('ai_confidence')}, ').') ELSE '' END)
        ELSE concat_ws(' ', concat('Decision: ', decision, ' | Score: ', score::VARCHAR, '/300.'),
            {part('intent_score > 0', "'[P1] Malicious code intent (+'", 'intent_score::VARCHAR', "').'")},
            {part('arabic_kw_score > 0', "'[P1] Arabic injection keyword (+'", 'arabic_kw_score::VARCHAR', "').'")},
            {part('code_score > 0', "'[P1] Suspicious code pattern (+'", 'code_score::VARCHAR', "').'")},
            {part('keyword_score > 0', "'[P1] Dangerous keywords (+'", 'keyword_score::VARCHAR', "').'")},
            {part('ar_fired', "'[P2-AR] '", 'ar_category', "' ('", 'ar_match_count::VARCHAR', "' pattern(s) matched).'")},
            {part('en_fired', "'[P2-EN] '", 'en_category', "' ('", 'en_match_count::VARCHAR', "' pattern(s) matched).'")},
            {part('matched_pattern IS NOT NULL', "'[P2] First match: '", truncate('matched_pattern', fv.REASON_MATCH_LEN))},
            {part('ai_activated AND ai_label IS NOT NULL', "'[P3-AI] '", 'ai_label', "' (confidence='", conf2('coalesce(ai_confidence, 0.0)'), "').'")})
        END"""
    vector = "CASE " + " ".join(
        f"WHEN regexp_matches(concat(coalesce(matched_pattern, ''), ' ', text), {lit('(?is)' + p)}) THEN {lit(label)}"
        for p, label in fv.VECTOR_RULES) + f" ELSE {lit(fv.VECTOR_NONE)} END"
    egypt = " + ".join(f"CASE WHEN contains(lower(text), {lit(m)}) THEN 1 ELSE 0 END" for m in fv.EGYPTIAN_MARKERS)
    has_ar, has_en = rx("text", fv.RE_ARABIC_CHAR), rx("text", fv.RE_ENGLISH)
    lang = f"""struct_pack(
        msa := CASE WHEN {has_ar} AND ({egypt}) = 0 THEN 60.0 WHEN {has_ar} THEN 20.0 ELSE 0.0 END::DOUBLE,
        egyptian := CASE WHEN {has_ar} THEN least(({egypt}) * 25.0, 90.0) ELSE 0.0 END::DOUBLE,
        franco := CASE WHEN {str(franco).lower()} AND ({rx('text', RE2_FRANCO)} OR {rx('text', RE2_FRANCO_WORDS)}) THEN 80.0 ELSE 0.0 END::DOUBLE,
        english := CASE WHEN {has_en} AND NOT {has_ar} THEN 55.0 WHEN {has_en} THEN 15.0 ELSE 0.0 END::DOUBLE,
        unicode := CASE WHEN {rx('text', fv.RE_UNICODE_OBFUSCATION)} THEN 85.0 ELSE 0.0 END::DOUBLE,
        encoded := CASE WHEN {rx('text', fv.RE_ENCODED)} THEN 85.0 ELSE 0.0 END::DOUBLE)"""
    flags = [
        (f"{rx('text', fv.RE_BASE64_RUN)} AND normalized_text <> text", "base64_decode"),
        (rx("text", RE2_FLAG_HEX), "hex_decode"),
        (f"{str(unicode_norm).lower()} AND {nfkc('text')} <> text", "unicode_nfkc"),
        (f"{html_unescape('text')} <> text", "html_unescape"),
        (rx("text", RE2_FLAG_SPLIT), "split_letter_merge"),
        (has_repeat("text"), "repetition_collapse"),
        (rx("text", fv.RE_ARABIC_VARIANTS), "arabic_normalize"),
    ]
    flag_list = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {lit(l)} END" for c, l in flags) + "], lambda x: x IS NOT NULL)"
    return f"""p0 AS (SELECT *{lists} FROM ({prompts})),
    p1 AS (SELECT p0.*, {intent_score(raw)}::INTEGER AS intent_score, {intent_rewrite(raw)} AS intent_text FROM p0),
    p2 AS (SELECT p1.*, {decoded} AS t9 FROM p1),
    p3 AS (SELECT p2.*, {deobfuscated} AS t10 FROM p2),
    p4 AS (SELECT p3.*, {collapse_repeats(merged)} AS normalized_text FROM p3),
    p5 AS (SELECT p4.*, {code_sql}::INTEGER AS code_score, ({phrases})::INTEGER AS arabic_kw_score,
                 ({kw})::INTEGER AS keyword_score,
                 (CASE WHEN {flag_list} = [] THEN ['none'] ELSE {flag_list} END) AS transformations FROM p4),
    p5b AS (SELECT p5.*, least(intent_score + code_score + arabic_kw_score + keyword_score, {fv.SCORE_CAP})::INTEGER AS base_score,
                 {layer_hits('normalized_text', 'arabic')} AS ar_hits, {layer_hits('normalized_text', 'english')} AS en_hits FROM p5),
    p5c AS (SELECT p5b.*, {decision} AS pipeline_decision,
                 len(ar_hits) > 0 AS ar_fired, len(en_hits) > 0 AS en_fired,
                 len(ar_hits)::INTEGER AS ar_match_count, len(en_hits)::INTEGER AS en_match_count,
                 CASE WHEN len(ar_hits) > 0 THEN coalesce({rule_attr('ar_hits[1]', 'category')}, '{fv.CATEGORY_UNKNOWN}') ELSE '{fv.CATEGORY_NONE}' END AS ar_category,
                 CASE WHEN len(en_hits) > 0 THEN coalesce({rule_attr('en_hits[1]', 'category')}, '{fv.CATEGORY_UNKNOWN}') ELSE '{fv.CATEGORY_NONE}' END AS en_category,
                 coalesce(ar_hits[1], en_hits[1]) AS matched_rule_id,
                 list_transform(ar_hits[1:3], lambda r: {truncate(rule_attr('r', 'pattern'), fv.MATCH_DISPLAY_LEN)}) AS ar_patterns,
                 list_transform(en_hits[1:3], lambda r: {truncate(rule_attr('r', 'pattern'), fv.MATCH_DISPLAY_LEN)}) AS en_patterns,
                 list_concat(ar_hits, en_hits) AS matched_rule_ids FROM p5b),
    p6 AS (SELECT p5c.*, {rule_attr('matched_rule_id', 'pattern')} AS matched_pattern,
                 list_transform(matched_rule_ids, lambda r: {rule_attr('r', 'pattern')}) AS all_matched_patterns,
                 CASE WHEN matched_rule_id IS NOT NULL AND pipeline_decision <> 'BLOCKED' THEN greatest({fv.REGEX_BLOCK_SCORE} - base_score, 0) ELSE 0 END::INTEGER AS regex_score_bump,
                 CASE WHEN matched_rule_id IS NOT NULL AND pipeline_decision <> 'BLOCKED' THEN greatest(base_score, {fv.REGEX_BLOCK_SCORE}) ELSE base_score END::INTEGER AS score_after_regex,
                 CASE WHEN matched_rule_id IS NOT NULL THEN 'BLOCKED' ELSE pipeline_decision END AS decision_after_regex FROM p5c),
    {ai}{after_ai},
    p10 AS (SELECT p9.*, {final_dec} AS decision, least(score_after_ai, {fv.SCORE_CAP})::INTEGER AS score FROM p9),
    p11 AS (SELECT p10.*, decision = 'BLOCKED' AS is_blocked, decision IN ('FLAG', 'BLOCKED') AS is_flagged FROM p10),
    screened AS (SELECT p11.*, {reason} AS reason,
        substr(sha256({lit(source + ':')} || prompt_id), 1, 32) AS id,
        TIMESTAMP {lit(logged_at)} AS timestamp,
        CASE WHEN is_blocked THEN 'BLOCKED' WHEN is_flagged THEN 'FLAGGED' ELSE 'SAFE' END AS status,
        CASE WHEN score >= {fv.RISK_CRITICAL} THEN 'CRITICAL' WHEN score >= {fv.RISK_HIGH} THEN 'HIGH'
             WHEN score >= {fv.RISK_MEDIUM} THEN 'MEDIUM' ELSE 'LOW' END AS risk,
        {vector} AS vector,
        CASE WHEN ai_prediction IS NOT NULL AND coalesce(length(matched_pattern) > 0, false) THEN 'AI+Regex'
             WHEN ai_prediction IS NOT NULL THEN 'AI'
             WHEN coalesce(length(matched_pattern) > 0, false) THEN 'Regex' ELSE 'Pipeline' END AS decision_source,
        {lang} AS lang_dist
      FROM p11)"""


def with_pipeline(prompts: str, select: str, **kw) -> str:
    return f"WITH {pipeline_ctes(prompts, **kw)}\n{select}"
