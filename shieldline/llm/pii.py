"""Personal data with offset-preserving deobfuscation.

Base identifiers (e-mail, IP, card, phone) are found in the text as written.
Then two transducers rewrite the text and keep, for every character they write,
the source range it stands for:

1. characters: invisible ones go; full-width forms, look-alike letters and the
   digits of other scripts become ASCII;
2. disguises: bracketed ``[at]``, ``(dot)`` and the like, ``name at host dot
   tld``, also with only the at or only the dots spoken, and runs of spelled
   digits become ``@``, ``.`` and digits.  So a word and ``at`` before a host
   count as an address, a sentence that says where something is ("look at
   example.com") too: of two errors, the one that leaves nothing unmasked.

The same identifiers are looked for in the rewritten text and mapped back to
source characters.  A mapped span is added where it overlaps no span of its
kind that is already there; base spans always stay.  A text that the rules
cannot change (no character that the first one maps, no cue) is not rewritten.

Null counts as empty: no spans.  Offsets are code points, ends exclusive.
Documents keep their other columns, whatever their names.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shieldline.llm.tables import aside, documents, extended, restored

KINDS = ("email", "ip", "card", "phone")

_EMAIL_RUN = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]*@[A-Za-z0-9._%+@-]*")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Latin letters that Greek and Cyrillic letters are mistaken for.
_LOOKALIKES = dict(zip(
    "аеорсухіјѕԁԛԝһӏАВЕКМНОРСТХІЈЅοανικρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijsdqwhlABEKMHOPCTXIJSoavikptuABEZHIKMNOPTYX", strict=True))
_INVISIBLE = "­​‌‍⁠﻿᠎"
_MARKS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
          "－": "-", "＋": "+", "﹢": "+", "（": "(", "）": ")", "＿": "_", " ": " ", " ": " ", " ": " ", " ": " ", "　": " "}


def _char(c: str) -> str:
    """What a character stands for: one ASCII character, nothing, or itself."""
    if c in _INVISIBLE:
        return ""
    if c in _MARKS:
        return _MARKS[c]
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if (d := unicodedata.digit(c, None)) is not None and unicodedata.category(c) in ("Nd", "No"):
        return str(d) if unicodedata.category(c) == "Nd" or "CIRCLED" in unicodedata.name(c, "") else c
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and n.isascii() and n.isalnum() else c


_known: dict[str, str] = {}


def _char_of(c: str) -> str:
    if (out := _known.get(c)) is None:
        out = _known[c] = _char(c)
    return out


_DIGITS = {w: d for d, ws in enumerate([
    "zero oh null cero zéro nul", "one eins uno un une", "two zwei dos deux", "three drei tres trois", "four vier cuatro quatre",
    "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf"]) for w in ws.split()}
_WORD_DIGIT = "|".join(sorted(_DIGITS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:{_WORD_DIGIT}|[0-9]+)(?:[ ,-]+(?:{_WORD_DIGIT}|[0-9]+))+(?!\w)", re.I)
_ONE = re.compile(rf"{_WORD_DIGIT}|[0-9]+", re.I)
_BRACKET = re.compile(r"(?<![ \t])[ \t]*(?:[\[({<][ \t]*(?:(at|@|arroba|ät)|(dot|punkt|punto|point|\.))[ \t]*[\])}>])[ \t]*", re.I)
_SPOKEN = re.compile(r"(?<![\w.%+-])([A-Za-z0-9._%+-]+)(\s+at\s+|@)([A-Za-z0-9-]+(?:(?:\s+dot\s+|\.)[A-Za-z0-9-]+)*(?:\s+dot\s+|\.)[A-Za-z]{2,24})(?![\w-])", re.I)
_AT_HOST = re.compile(r"\sat\s+[A-Za-z0-9-]+\.", re.I)
_SPACED = re.compile(r"(?<=[A-Za-z0-9._%+-])[ \t]+@[ \t]+(?=[A-Za-z0-9-]+\.)|(?<=[A-Za-z0-9_%+-])[ \t]+@(?=[A-Za-z0-9-]+\.)|(?<=[A-Za-z0-9_%+-])@[ \t]+(?=[A-Za-z0-9-]+\.[A-Za-z])")
_DOT = re.compile(r"(?<!\s)\s+dot\s+", re.I)
_DOTTED = re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\s+dot\s+|\.)[0-9]{1,3}){3}(?![\w])", re.I)
_PAIR = re.compile(rf"(?<!\w)(?:{_WORD_DIGIT})[ ,-]+(?:{_WORD_DIGIT}|[0-9])", re.I)
_MIXED = re.compile(rf"[0-9][ ,-]+(?:{_WORD_DIGIT})(?!\w)", re.I)


def _low(text: str) -> str:
    """Lower case, with the two letters that patterns take for an i as one."""
    return text.lower().replace("i\u0307", "i").replace("\u0131", "i")


def _cue(text: str) -> bool:
    """Whether the second transducer could change the text."""
    low = _low(text)
    if "@" in low and _SPACED.search(text) or _BRACKET_SIGN.search(low) and _BRACKET.search(text):
        return True
    if ("dot" in low and _DOT.search(low) or _AT_HOST.search(low)) and (_SPOKEN.search(text) or _DOTTED.search(text)):
        return True
    return not _SURE.isdisjoint(_LETTERS.findall(low)) and bool(_PAIR.search(low) or _MIXED.search(low))


#: Number words that are no articles or other common words: a run of spelled digits has one at least.
_SURE = {*_DIGITS} - {"oh", "null", "nul", "un", "uno", "une"}
_BRACKET_SIGN = re.compile(r"[\[({<]")
_LETTERS = re.compile(r"[^\W\d_]+")


def _foreign(text: str) -> bool:
    """Whether the first transducer changes the text: asked of the transducer itself."""
    return not text.isascii() and any(c >= "\x80" and _char_of(c) != c for c in set(text))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Addresses of a run of their characters, leftmost first: for each sign the
    longest name that is free before it, and a dotted host behind it."""
    out, free = [], start
    at = text.find("@", start, end)
    while at >= 0:
        host = _HOST.match(text, at + 1, end) if at > free else None
        if host:
            out.append((free, host.end()))
        after = host.end() if host else at + 1
        at = text.find("@", after, end)
        free = after
    return out


def _byte(digits: str) -> bool:
    """Whether a number is 255 at most, however long it is written."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def find(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the identifiers of a text as written, by kind and
    start.  Time is in proportion to the text: a search never starts again
    within a run that has failed from its start."""
    out = []
    if "@" in text:
        for run in _EMAIL_RUN.finditer(text):
            out += [(0, a, b) for a, b in _emails(text, *run.span())]
    if not _HAS_DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_byte, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


_HAS_DIGIT = re.compile("[0-9]")


class Mapped:
    """A rewritten text with the source range of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)

    def characters(self) -> None:
        """The first transducer: one character at a time."""
        out, start, end = [], [], []
        for i, c in enumerate(self.text):
            n = c if c < "\x80" else _char_of(c)
            if n:
                out.append(n)
                start.append(i)
                end.append(i + 1)
        self.text, self.start, self.end = "".join(out), start, end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces ranges of the text; each character written stands for its whole range."""
        if not edits:
            return
        out, start, end, at = [], [], [], 0
        for s, e, new in edits:
            out.append(self.text[at:s])
            start += self.start[at:s]
            end += self.end[at:s]
            out.append(new)
            start += [self.start[s]] * len(new)
            end += [self.end[e - 1]] * len(new)
            at = e
        out.append(self.text[at:])
        self.text, self.start, self.end = "".join(out), [*start, *self.start[at:]], [*end, *self.end[at:]]

    def disguises(self) -> None:
        """The second transducer: at, dot and spelled digits."""
        self.rewrite([(*m.span(), "@" if m[1] else ".") for m in _BRACKET.finditer(self.text)])
        edits = []
        for m in _SPOKEN.finditer(self.text):
            edits.append((*m.span(2), "@"))
            edits += [(m.start(3) + d.start(), m.start(3) + d.end(), ".") for d in _DOT.finditer(m[3])]
        self.rewrite(edits)
        self.rewrite([(*m.span(), "@") for m in _SPACED.finditer(self.text)])
        self.spelled()
        self.rewrite([(m.start() + d.start(), m.start() + d.end(), ".") for m in _DOTTED.finditer(self.text) for d in _DOT.finditer(m.group())])

    def spelled(self) -> None:
        """Runs of spelled digits, written as digits without what stands between."""
        edits = []
        for m in _SPELLED.finditer(self.text):
            run = m.group()
            parts = list(_ONE.finditer(run))
            if _SURE.isdisjoint(_low(p.group()) for p in parts):
                continue
            for k, p in enumerate(parts):
                stop = parts[k + 1].start() if k + 1 < len(parts) else p.end()
                if not p.group().isdigit():
                    edits.append((m.start() + p.start(), m.start() + stop, str(_DIGITS[_low(p.group())])))
        self.rewrite(edits)


def find_all(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, spans that deobfuscation adds), each by kind and start."""
    if not text:
        return [], []
    base = find(text)
    foreign = _foreign(text)
    if not foreign and not _cue(text):
        return base, []
    m = Mapped(text)
    if foreign:
        m.characters()
    m.disguises()
    if m.text == text:
        return base, []
    taken = {k: [(s, e) for kind, s, e in base if kind == k] for k in range(len(KINDS))}
    added = []
    for kind, s, e in find(m.text):
        own, span = taken[kind], (m.start[s], m.end[e - 1])
        k = bisect.bisect_left(own, span)  # spans of a kind do not overlap: only the neighbours can
        if (k == 0 or own[k - 1][1] <= span[0]) and (k == len(own) or span[1] <= own[k][0]):
            own.insert(k, span)
            added.append((kind, *span))
    return base, sorted(added)


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


_ADDED = ["n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans", "masked"]


def find_personal_data(docs: DataFrame, text_col: str = "text", mask: bool = False) -> DataFrame:
    """``docs`` with the counts of base spans by kind, base_spans and spans
    ("kind:start:end", comma-joined) and, with ``mask``, the text with each
    span replaced by its kind in brackets."""
    added = _ADDED if mask else _ADDED[:-1]
    kept = [c for c in docs.columns if c not in added]
    out = docs.select(*kept)
    place = kept.index(text_col)
    schema = extended(out, ", ".join([*(f"{c} bigint" for c in added[:4]), *(f"{c} string" for c in added[4:])]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, told, every, masked = [[], [], [], []], [], [], []
            for text in batch.column(place).to_pylist():
                base, more = find_all(text)
                for k in range(4):
                    counts[k].append(sum(kind == k for kind, _, _ in base))
                told.append(_told(base))
                every.append(_told(sorted(base + more)))
                if mask:
                    masked.append(mask_text(text, base + more))
            arrays = [*(pa.array(c, pa.int64()) for c in counts), pa.array(told, pa.string()), pa.array(every, pa.string())]
            if mask:
                arrays.append(pa.array(masked, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*kept, *added])

    return out.mapInArrow(scan, schema)


def mask_text(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span replaced; of overlapping ones the first stands for all."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in the text masked and n_chars anew;
    their other columns stay, whatever their names."""
    found = restored(find_personal_data(aside(docs, _ADDED), mask=True).withColumn("text", F.col("masked")).drop(*_ADDED))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*docs.columns)
