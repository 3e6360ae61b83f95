"""The only per-row Python in the text pipeline: Unicode NFKC and HTML entity
unescaping, which Spark has no built-in for.

Rows are gated natively first: a text made only of characters that NFKC leaves
alone (see ``nfkc_stable_class``) and without ``&`` never reaches Python — the
UDF receives NULL for it, which costs nothing in the Arrow batch.
"""

from __future__ import annotations

import html
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scripts screened by the engine; characters of these blocks that NFKC maps to
# themselves and that never combine with a neighbour are "stable".
_SCANNED_BLOCKS = [
    (0x0000, 0x024F),   # Basic Latin .. Latin Extended-B
    (0x0370, 0x04FF),   # Greek, Cyrillic
    (0x0600, 0x06FF),   # Arabic
    (0x2010, 0x2027),   # dashes, quotes, bullets
]


@lru_cache(maxsize=1)
def nfkc_stable_class() -> str:
    """Character class (Java syntax) of characters NFKC leaves unchanged in
    any context, derived from the Unicode database rather than listed."""
    stable: list[int] = []
    for lo, hi in _SCANNED_BLOCKS:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            if 0xD800 <= cp <= 0xDFFF:
                continue
            if unicodedata.combining(ch) != 0:
                continue
            if unicodedata.normalize("NFKC", ch) != ch:
                continue
            stable.append(cp)
    ranges: list[tuple[int, int]] = []
    for cp in stable:
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1] = (ranges[-1][0], cp)
        else:
            ranges.append((cp, cp))
    body = "".join(
        f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges
    )
    return "[" + body + "]"


#: Most texts: ASCII and Latin letters that NFKC leaves alone.
RX_STABLE = r"^[\x{0}-\x{9F}\x{BF}-\x{131}]*+\z"


def needs_python_fixups(raw: Column) -> Column:
    """True when NFKC or HTML unescaping could change ``raw``."""
    unstable = r"(?![\x{00}-\x{7F}])[^" + nfkc_stable_class()[1:]  # ASCII is told by one comparison
    return (~raw.rlike(RX_STABLE) & raw.rlike(unstable)) | raw.contains("&")


_FIX_TYPE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("nfkc_changed", T.BooleanType()),
    T.StructField("html_changed", T.BooleanType()),
])


@F.pandas_udf(_FIX_TYPE)
def _fixups(raw: pd.Series, text: pd.Series, nfkc: pd.Series) -> pd.DataFrame:
    out_text, nfkc_changed, html_changed = [], [], []
    for r, t, wanted in zip(raw, text, nfkc):
        if r is None:
            out_text.append(None)
            nfkc_changed.append(None)
            html_changed.append(None)
            continue
        nfkc_changed.append(bool(wanted) and unicodedata.normalize("NFKC", r) != r)
        html_changed.append(html.unescape(r) != r)
        out_text.append(None if t is None else html.unescape(unicodedata.normalize("NFKC", t) if wanted else t))
    return pd.DataFrame(
        {"text": out_text, "nfkc_changed": nfkc_changed, "html_changed": html_changed}
    )


def fixups_gate(raw: Column, nfkc: bool = True) -> Column:
    return needs_python_fixups(raw) if nfkc else raw.contains("&")


def python_fixups(raw: Column, text: Column, nfkc: bool = True, gate: Column | None = None) -> Column:
    """Struct(text, nfkc_changed, html_changed).  ``text`` is NFKC (if wanted)
    and unescape of ``text``; the flags compare ``raw`` with its NFKC /
    unescaped form.  Rows that neither can change get the identity result
    without leaving the JVM.  ``gate`` is the column that holds ``fixups_gate``,
    if there is one: the struct uses it six times."""
    gate = fixups_gate(raw, nfkc) if gate is None else gate
    res = _fixups(F.when(gate, raw), F.when(gate, text), F.lit(nfkc))
    return F.struct(
        F.when(gate, res["text"]).otherwise(text).alias("text"),
        F.when(gate, res["nfkc_changed"]).otherwise(F.lit(False)).alias("nfkc_changed"),
        F.when(gate, res["html_changed"]).otherwise(F.lit(False)).alias("html_changed"),
    )
