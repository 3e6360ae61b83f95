"""Normalisation stages as Spark column expressions.

Each stage maps a string column to a string column with built-in functions.
Whole-text functions (regexp, translate) run inside whole-stage codegen;
higher-order array functions do not, so each is gated by the pattern that it
rewrites.  A stage may use its input several times: chain stages as columns of
their own (``stages``), never as one nested expression.  Python-style
"replace each match by f(match)" is expressed with the interleave idiom:
``split(x, p, -1)`` gives the n+1 gaps, ``regexp_extract_all(x, p, 0)`` the n
matches; ``transform`` rewrites the matches and ``zip_with`` + ``array_join``
stitches the text back together.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .regex import ALNUM, BOW, EOW, NOT_WORD, SPACE, SPACE_CHARS, SPACE_TEXT, WORD, WORD_CHARS, ci, portable, singles

# ---------------------------------------------------------------------------
# helpers
# ---------------------------------------------------------------------------


def replace_matches(text: Column, pattern: str, rewrite) -> Column:
    """Replace every match of ``pattern`` in ``text`` by ``rewrite(match)``."""
    gaps = F.split(text, pattern, -1)
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), rewrite)
    stitched = F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit(""))))
    return F.array_join(stitched, "")


def rewrite_segments(text: Column, pattern: str, rewrite) -> Column:
    """``pattern`` must partition the text (every char in exactly one match)."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), rewrite), "")


def py_strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_TEXT))


def bound(value: Column, use) -> Column:
    """``use(value)``, evaluating ``value`` once however often it is used."""
    return F.transform(F.array(value), use)[0]


def arabic_fold_py(s: str) -> str:
    """Fold a literal (phrases, markers) the way ``norm_arabic`` folds text."""
    import re

    s = re.sub(fv.ARABIC_DIACRITICS, "", s)
    return s.translate(str.maketrans(fv.ARABIC_FOLD_FROM, fv.ARABIC_FOLD_TO))


# ---------------------------------------------------------------------------
# step 1: intent rewrite (raw text)
# ---------------------------------------------------------------------------
RX_LOOP = ci(portable(fv.RE_INFINITE_LOOP))
RX_LOOP_WORD = ci(fv.RE_LOOP_EXPLOIT_WORD)
RX_LOOP_BODY = portable(fv.RE_INFINITE_LOOP_BODY)            # case-sensitive on purpose
RX_CONSOLE = ci(portable(fv.RE_CONSOLE_LEAK))
RX_EVIL = ci(BOW + portable(fv.RE_EVIL_CALL.replace(r"\b", "", 1)))
RX_CLASSIC = "(?=[" + "".join(sorted({f(p[0]) for p in fv.RE_CLASSIC_PHRASE.split("|") for f in (str.lower, str.upper)})) + "])" + ci(f"(?:{fv.RE_CLASSIC_PHRASE})")


def intent_signals(raw: Column) -> dict[str, Column]:
    # The first three need a parenthesis; a null text stays null.
    none = ~raw.contains("(")
    loop = ~none & raw.rlike(RX_LOOP) & raw.rlike(RX_LOOP_WORD)
    return {
        "loop": loop,
        "n_console": F.when(none, 0).otherwise(F.regexp_count(raw, F.lit(RX_CONSOLE))),
        "n_evil": F.when(none, 0).otherwise(F.regexp_count(raw, F.lit(RX_EVIL))),
        "classic": raw.rlike(RX_CLASSIC),
    }


def intent_score(raw: Column) -> Column:
    s = intent_signals(raw)
    # The benign-code -25 of this step is inert: the score is floored at 0
    # and can only be 0 when the penalty applies.
    return (
        F.when(s["loop"], fv.W_INFINITE_LOOP).otherwise(0)
        + s["n_console"] * fv.W_CONSOLE_LEAK
        + s["n_evil"] * fv.W_EVIL_CALL
        + F.when(s["classic"], fv.W_CLASSIC_PHRASE).otherwise(0)
    ).cast("int")


def intent_rewrite(raw: Column) -> Column:
    s = intent_signals(raw)
    return rewritten(raw, s["loop"], s["n_console"], s["n_evil"], s["classic"])


def _replace_literals(text: Column, raw: Column, some: Column, pattern: str, token: str) -> Column:
    """Every occurrence in ``text`` of what ``pattern`` finds in ``raw``, if ``some``."""
    found = F.when(some, F.array_distinct(F.regexp_extract_all(raw, F.lit(pattern), 0))).otherwise(F.array().cast("array<string>"))
    return F.aggregate(found, text, lambda acc, m: F.replace(acc, m, F.lit(token)))


def rewritten(raw: Column, loop: Column, n_console: Column, n_evil: Column, classic: Column) -> Column:
    """The rewrite, given the signals.  Leaks and calls are literals found in
    the raw text, and all their occurrences go; a text without a signal is only
    stripped."""
    some = loop | (n_console > 0) | (n_evil > 0) | classic
    t = F.when(loop, F.regexp_replace(raw, RX_LOOP_BODY, fv.TOKEN_INFINITE_LOOP)).otherwise(raw)
    t = _replace_literals(t, raw, n_console > 0, RX_CONSOLE, fv.TOKEN_DATA_LEAK)
    t = _replace_literals(t, raw, n_evil > 0, RX_EVIL, fv.TOKEN_EVIL_CALL)
    return py_strip(F.when(some, F.regexp_replace(t, RX_CLASSIC, fv.TOKEN_JAILBREAK)).otherwise(raw))


# ---------------------------------------------------------------------------
# steps 5b-7: tags, Arabic folding, emoji
# ---------------------------------------------------------------------------


def stages(df: DataFrame, start: Column, steps: list, out: str) -> DataFrame:
    """``out`` = the steps applied to ``start`` in turn, each in a column of its
    own: a step that uses its input several times evaluates it once."""
    df = df.withColumn("_stage", start)
    for step in steps:
        df = df.withColumn("_stage", step(F.col("_stage")))
    return df.withColumnRenamed("_stage", out)


def strip_tags(text: Column) -> Column:
    return F.when(text.contains("<"), F.regexp_replace(text, fv.RE_HTML_TAG, "")).otherwise(text)


#: Folding and dropping emoji leave these texts alone.
RX_BEFORE_ARABIC = r"^[\x{0}-\x{5FF}]*+\z"


def arabic_fold(text: Column) -> Column:
    return F.when(~text.rlike(RX_BEFORE_ARABIC), F.translate(F.regexp_replace(text, fv.ARABIC_DIACRITICS, ""),
                                                     fv.ARABIC_FOLD_FROM, fv.ARABIC_FOLD_TO)).otherwise(text)


RX_EMOJI = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in fv.EMOJI_RANGES) + "]"


def drop_emoji(text: Column) -> Column:
    return F.when(~text.rlike(RX_BEFORE_ARABIC), F.regexp_replace(text, RX_EMOJI, "")).otherwise(text)


# ---------------------------------------------------------------------------
# steps 8-9: base64 / hex runs
# ---------------------------------------------------------------------------
PRINTABLE = r"^[\x{20}-\x{7E}]+$"
RX_WORD_SEGMENTS = f"{WORD}+|{NOT_WORD}+"


def _b64_taken(seg: Column) -> Column:
    """How many data characters of a run a lenient decoder reads: "=" is passed
    over until it completes a group of four; what is behind that is not read.
    -1 if the run ends within a group."""
    padded = F.rpad(seg, ((F.length(seg) + 3) / 4).cast("int") * 4, "=")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("pads"), F.lit(False).alias("done"))

    def step(s: Column, c: Column) -> Column:
        pads = F.when((c == "=") & (s["n"] % 4 >= 2), s["pads"] + 1).when(c == "=", s["pads"]).otherwise(0)
        return F.when(s["done"], s).otherwise(F.struct(
            (s["n"] + F.when(c == "=", 0).otherwise(1)).alias("n"), pads.alias("pads"),
            ((c == "=") & (s["n"] % 4 >= 2) & (s["n"] % 4 + pads >= 4)).alias("done")))

    return F.aggregate(F.split(padded, ""), start, step, lambda s: F.when(s["done"] | (s["n"] % 4 == 0), s["n"]).otherwise(-1))


def _b64_segment(seg: Column) -> Column:
    plain = F.regexp_replace(seg, "=+$", "")
    data = F.when(plain.contains("="), F.substring(F.replace(plain, F.lit("="), F.lit("")), F.lit(1), F.greatest(_b64_taken(seg), F.lit(0)))).otherwise(plain)
    n = F.length(data)
    padded = F.rpad(data, ((n + 3) / 4).cast("int") * 4, "=")
    decoded = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when((n % 4 != 1) & decoded.rlike(PRINTABLE), decoded).otherwise(seg)


def _b64_printable() -> str:
    """A group of four data characters whose three bytes are printable."""
    data = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    at = lambda ok: "[" + "".join(c for i, c in enumerate(data) if ok(i)) + "]"
    return at(lambda i: 8 <= i < 32) + at(lambda i: 2 <= i % 16 < 8) + at(lambda i: i % 4 < 2) + "[A-Za-z0-9+/]"


#: The beginning of a run without "=" that may decode to printable text.
_B64_ANY = "[A-Za-z0-9+/=]"
RX_B64_CANDIDATE = f"{_b64_printable()}(?<!{_B64_ANY}.{{4}}){_b64_printable()}"


def decode_base64_runs(text: Column) -> Column:
    return F.when((text.contains("=") | text.rlike(RX_B64_CANDIDATE)) & text.rlike(fv.RE_BASE64_RUN), replace_matches(text, fv.RE_BASE64_RUN, _b64_segment)).otherwise(text)


def _hex_segment(seg: Column) -> Column:
    decoded = F.try_to_binary(seg, F.lit("hex")).cast("string")
    ok = seg.rlike("^[0-9a-fA-F]{8,}$") & (F.length(seg) % 2 == 0) & decoded.rlike(PRINTABLE)
    return F.when(ok, decoded).otherwise(seg)


RX_HEX_CANDIDATE = f"{BOW}[0-9a-fA-F]{{8,}}{EOW}"
RX_HEX_PRINTABLE = "(?:[2-7][0-9a-fA-F]){4}"  # in every run that decodes to printable text


def decode_hex_runs(text: Column) -> Column:
    # The segment rewrite (an interpreted higher-order function) only runs on
    # rows that hold a whole-word hex run; elsewhere it is the identity.
    return F.when(text.rlike(RX_HEX_PRINTABLE) & text.rlike(RX_HEX_CANDIDATE), rewrite_segments(text, RX_WORD_SEGMENTS, _hex_segment)) \
        .otherwise(text)


# ---------------------------------------------------------------------------
# step 10: token de-obfuscation (ROT13 + confusables) and re-join
# ---------------------------------------------------------------------------
RX_TOKENS = f"{WORD}+|[^{WORD_CHARS}{SPACE_CHARS}]"
_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ROT13 = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"
CONF_FROM = "".join(fv.CONFUSABLES.keys())
CONF_TO = "".join(fv.CONFUSABLES.values())


def rot13(c: Column) -> Column:
    return F.translate(c, _ASCII, _ROT13)


def deobfuscate_token(tok: Column, use_rot13: bool = True, use_confusables: bool = True, flips: Column | None = None) -> Column:
    """ROT13 reading when the lexicon prefers it (``flips`` holds the tokens of
    the text where it does, if given), then lower-case and map confusables;
    tokens without an ASCII letter/digit or @$§!+ pass as-is."""
    chosen = tok
    if use_rot13:
        rot = rot13(tok)
        take_rot = F.lower(rot).isin(fv.LEXICON) & ~F.lower(tok).isin(fv.LEXICON) if flips is None else F.array_contains(flips, tok)
        chosen = F.when(take_rot, rot).otherwise(tok)
    mapped = F.translate(F.lower(chosen), CONF_FROM, CONF_TO) if use_confusables else chosen
    return F.when(tok.rlike(fv.DEOBFUSCATION_GATE), mapped).otherwise(tok)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RX_TOKENS), 0)


TOKEN_MODES = {"full": (True, True), "join": (False, False), "rot13": (True, False), "confusables": (False, True)}


#: Tokens that ROT13 turns into a lexicon word.
_ROT_WORDS = [w.translate(str.maketrans(_ASCII, _ROT13)) for w in fv.LEXICON]
_ROT_FIRST = "".join(sorted({c for w in _ROT_WORDS for c in (w[0], w[0].upper())}))
RX_ROT13 = f"[^{ALNUM}](?=[{_ROT_FIRST}])(?i:" + "|".join(_ROT_WORDS) + f"){EOW}"  # behind a blank or other text

#: Characters that lower-casing or the confusables would change, of which a token
#: of the gate needs none: in a token without one of the gate they stay.
_CHANGED = "".join(c for c in dict.fromkeys(CONF_FROM) if not c.isascii() and c != "\u00a7")
RX_CHANGED = f"[{_CHANGED}\\p{{IsUppercase}}\\p{{Lt}}&&[^\\x{{00}}-\\x{{7F}}]]"
_PLAIN = f"[{WORD_CHARS}&&[^A-Za-z0-9]]"  # of a word, but not of the gate
RX_KEPT = f"(?![\\x{{00}}-\\x{{7F}}])(?:(?<!{WORD}){_PLAIN}*{RX_CHANGED}{_PLAIN}*(?!{WORD})|[{RX_CHANGED}&&[^{WORD_CHARS}]])"


RX_KEPT_CANDIDATE = rf"[^\x{{0}}-\x{{7F}}](?<![{ALNUM}].)"  # where tokens are set apart

#: Signs of the gate: each is a token, and becomes a letter.
_SIGNS = "@$§+!"
RX_SIGN_END = f"([{_SIGNS}])(?={WORD})"
#: Classes of single characters for Latin texts.  Words with "_" take no blank, and
#: lower-casing makes two characters of U+0130: only tokens get these right.
_LATIN = [chr(i) for i in range(0x250)]
_LATIN_SPACE = singles(c for c in _LATIN if c in SPACE_TEXT)
_LATIN_PUNCT = [c for c in _LATIN if unicodedata.category(c)[0] not in "LN" and c not in SPACE_TEXT and c != "_"]
_LATIN_WORD = singles(c for c in _LATIN[:0x100] if unicodedata.category(c)[0] in "LN") + r"\x{100}-\x{24F}"
RX_LATIN = r"^[\x{0}-\x{24F}&&[^_\x{130}]]*+\z"
RX_LATIN_SPACE_BEHIND = tuple(f"([{singles(c for c in _LATIN_PUNCT if c not in x)}])[{_LATIN_SPACE}]++" for x in (_SIGNS, ""))  # with and without mapping
RX_LATIN_ODD_SPACE = f"[{_LATIN_SPACE}](?:[{_LATIN_SPACE}]++|(?<! ))"
RX_LATIN_WORD_END = tuple(f"([{singles(_LATIN_PUNCT)}])(?<=[{_LATIN_WORD}{x}][^\\x{{100}}])" for x in (_SIGNS, ""))


def deobfuscate_tokens(text: Column, use_rot13: bool = True, mode: str = "full", flips: Column | None = None) -> Column:
    """Tokenise, rewrite each token, and re-join with a space after every
    alphanumeric token.  ``mode`` isolates one rewrite for stage queries.
    ``flips`` (array, null for none) holds the tokens that ROT13 turns where
    the lexicon is a table (``operators.user_tables``).

    Latin texts without a ROT13 form of a lexicon word are rewritten whole: blanks
    are set where tokens end, and letters mapped.  Mapping must not touch a token
    without a character of the gate; a text is cut at those that it would change.
    Other texts go token by token, which is faster there than classes of all scripts."""
    rot, conf = TOKEN_MODES[mode]
    rot = rot and use_rot13
    whole = text.rlike(RX_LATIN)
    if rot:
        whole = whole & (~F.concat(F.lit(" "), text).rlike(RX_ROT13) if flips is None else flips.isNull())
    flips = None if flips is None else F.coalesce(flips, F.array().cast("array<string>"))
    return F.when(whole, _whole_tokens(text, conf)).otherwise(_each_token(text, rot, conf, flips))


def _whole_tokens(text: Column, conf: bool) -> Column:
    spaced = _spaced(text, conf)
    return F.rtrim(bound(spaced, _mapped) if conf else spaced)


def _spaced(text: Column, conf: bool) -> Column:
    behind, end = (x[0 if conf else 1] for x in (RX_LATIN_SPACE_BEHIND, RX_LATIN_WORD_END))
    spaced = F.regexp_replace(F.ltrim(text, F.lit(SPACE_TEXT)), behind, "$1")
    spaced = F.regexp_replace(F.regexp_replace(spaced, RX_LATIN_ODD_SPACE, " "), end, " $1")
    return F.regexp_replace(spaced, RX_SIGN_END, "$1 ") if conf else spaced


def _mapped(text: Column) -> Column:
    pairs = [(a, b) for a, b in fv.CONFUSABLES.items() if a != "|"]  # "|" alone is no token of the gate

    def low(t: Column) -> Column:
        return F.translate(F.lower(t), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))

    ascii_low = F.lower(text)
    for a, b in pairs:
        ascii_low = F.replace(ascii_low, F.lit(a), F.lit(b)) if a.isascii() else ascii_low
    kept = F.regexp_extract_all(text, F.lit(RX_KEPT), 0)
    cut = F.array_join(F.zip_with(F.transform(F.split(text, RX_KEPT, -1), low), kept, lambda g, k: F.concat(g, F.coalesce(k, F.lit("")))), "")
    return F.when(F.octet_length(text) == F.length(text), ascii_low).when(text.rlike(RX_KEPT_CANDIDATE) & text.rlike(RX_KEPT), cut).otherwise(low(text))


def _each_token(text: Column, rot: bool, conf: bool, flips: Column | None = None) -> Column:
    toks = tokens(text)
    if rot or conf:
        toks = F.transform(toks, lambda t: deobfuscate_token(t, rot, conf, flips))
    spaced = F.transform(toks, lambda t: F.when(t.rlike(r"^[\p{L}\p{N}]+$"), F.concat(t, F.lit(" "))).otherwise(t))
    return F.rtrim(F.array_join(spaced, ""))


# ---------------------------------------------------------------------------
# steps 11-12: split letters, repetition collapse
# ---------------------------------------------------------------------------
_LETTER = r"[\p{L}\p{N}_\x{0600}-\x{06FF}]"
_SEP = f"[{SPACE_CHARS}\\-_]"
RX_SPLIT_RUN = f"(^|{SPACE})((?:{_LETTER}{_SEP}+){{2,}}{_LETTER})(?={SPACE}|$)"
_SINGLE = f"(?:{BOW}[A-Za-z0-9]{EOW}|(?<={WORD})[@$#](?={WORD}))"
RX_SINGLES_RUN = f"(?:{_SINGLE}{SPACE}*){{3,}}"


#: In every run of split letters, and in every run of single ones.
RX_SPLIT_CANDIDATE = f"[{_LATIN_SPACE}_-]{_LETTER}(?![{ALNUM}]){_SEP}+{_LETTER}(?={SPACE}|$)"  # where no blank is beyond:
RX_LOW_BLANKS = r"^[\x{0}-\x{167F}]*+\z"
RX_SINGLES_CANDIDATE = f"(?<![{ALNUM}])[{ALNUM}](?![{ALNUM}]){SPACE}*(?:[A-Za-z0-9]{EOW}|[@$#](?={WORD}))"


def merge_spaced_runs(text: Column) -> Column:
    def _merge(m: Column) -> Column:
        return F.concat(F.regexp_extract(m, f"^{SPACE}", 0), F.regexp_replace(m, _SEP, ""))

    return F.when((text.rlike(RX_SPLIT_CANDIDATE) | ~text.rlike(RX_LOW_BLANKS)) & text.rlike(RX_SPLIT_RUN), replace_matches(text, RX_SPLIT_RUN, _merge)).otherwise(text)


def merge_single_letters(text: Column) -> Column:
    return F.when(text.rlike(RX_SINGLES_CANDIDATE) & text.rlike(RX_SINGLES_RUN),
                  replace_matches(text, RX_SINGLES_RUN, lambda m: F.regexp_replace(m, SPACE, ""))).otherwise(text)


RX_REPEAT = r"([^\n])\1{3,}"


def collapse_repeats(text: Column) -> Column:
    return F.regexp_replace(text, RX_REPEAT, "$1")
