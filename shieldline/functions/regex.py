"""Regex portability between Python semantics, Java (Spark) and RE2 (DuckDB).

Python's ``re`` treats ``\\w``, ``\\s`` and ``\\b`` as Unicode-aware; Java and
RE2 treat ``\\w``/``\\s`` as ASCII.  Every pattern that reaches Spark therefore
spells these classes out.  ``.`` is rewritten to ``[^\\n]`` because Java's dot
also stops at ``\\r``, U+0085, U+2028 and U+2029 while Python's stops only at
``\\n``.
"""

from __future__ import annotations

# Python's Unicode \w: letters, numbers, underscore.
WORD_CHARS = r"\p{L}\p{N}_"
WORD = f"[{WORD_CHARS}]"
NOT_WORD = f"[^{WORD_CHARS}]"

# Python's Unicode \s (str.isspace): ASCII whitespace, the information
# separators, NEL, NBSP and the Unicode space separators.
SPACE_CHARS = (
    r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
SPACE = f"[{SPACE_CHARS}]"
#: The same characters as a literal, for trimming.
SPACE_TEXT = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_SPACE = f"[^{SPACE_CHARS}]"

#: Java tests a class of single characters below U+0100 by one bit, ranges and
#: properties one after the other; patterns that read every text begin with these.
ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

# Java look-arounds standing in for Python's Unicode \b next to a word char.
BOW = f"(?<!{WORD})"      # start of word
EOW = f"(?!{WORD})"       # end of word


def portable(pattern: str) -> str:
    """Rewrite ``\\w \\W \\s \\S`` and ``.`` of a Python pattern into explicit
    classes valid for both Java and RE2.  ``\\b`` is left alone: callers that
    need it build look-arounds (Java) or consuming groups (RE2)."""
    out: list[str] = []
    in_class = False
    i = 0
    n = len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "\\" and i + 1 < n:
            nxt = pattern[i + 1]
            if nxt == "w":
                out.append(WORD_CHARS if in_class else WORD)
            elif nxt == "W":
                if in_class:
                    raise ValueError("\\W inside a class is not portable: " + pattern)
                out.append(NOT_WORD)
            elif nxt == "s":
                out.append(SPACE_CHARS if in_class else SPACE)
            elif nxt == "S":
                if in_class:
                    raise ValueError("\\S inside a class is not portable: " + pattern)
                out.append(NOT_SPACE)
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if in_class:
            if ch == "]" and not (out and out[-1] in ("[", "[^")):
                in_class = False
            out.append(ch)
        elif ch == "[":
            in_class = True
            if i + 1 < n and pattern[i + 1] == "^":
                out.append("[^")
                i += 2
                continue
            out.append(ch)
        elif ch == ".":
            out.append(r"[^\n]")
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def ci(pattern: str) -> str:
    """Case-insensitive form of a portable pattern."""
    return "(?i)" + pattern


def char_ranges_class(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def alternation(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def singles(chars) -> str:
    """The inside of a class of single characters."""
    return "".join(f"\\x{{{ord(c):X}}}" for c in chars)
