"""Whole Arrow batches of texts as numpy arrays: words, hashes, shingles.

A batch of texts is one byte buffer with offsets, as Arrow stores it.  Words
are found and hashed for the whole buffer at once, so the cost per word stays
far below a Python call.  A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words that end at blanks: all but space and \x09-\x0D.
BLANK_WORD = np.ones(256, dtype=bool)
BLANK_WORD[[0x20, *range(0x09, 0x0E)]] = False


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (wrapping arithmetic)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = splitmix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_R = 0x9E3779B97F4A7C1B  # odd, 3 modulo 8: its powers differ in low bits
_RINV = pow(_R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and doubled as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, dtype=U64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
        if len(have) <= 1 << 23:
            _powers[base] = have
    return have[:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets has one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = column.cast(pa.large_binary())
    _, off, data = wide.buffers()
    if len(wide) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(wide) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each (one row at least): bounds memory."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def fold(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte; other bytes stay."""
    return _LOWER[raw]


def words(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = BLANK_WORD):
    """(starts, ends, first): byte bounds of all words, and for each text the
    number of words before it (one entry more than texts)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    at = offsets[:-1]
    at = at[at < n]
    begin[at] = inside[at]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    end[last] = inside[last]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for every span: a polynomial with random
    byte values modulo 2**64, then mixed with the length."""
    n = len(raw)
    total = np.empty(n + 1, dtype=U64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * _pow(_R, n), out=total[1:])
    h = (total[ends] - total[starts]) * _pow(_RINV, n + 1)[starts]
    return splitmix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


_C = 0x8CB92BA72F3D8DD7


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = 5):
    """(shingle hashes, text numbers): all runs of ``size`` words; a text of
    fewer words, but not none, is one shingle of all its words."""
    count = np.diff(first)
    texts = np.arange(len(count))
    out, own = [], []
    n = len(hashes)
    if n >= size:
        total = np.zeros(n - size + 1, dtype=U64)
        for j in range(size):
            total += hashes[j : n - size + 1 + j] * U64(pow(_C, j, 1 << 64))
        text = np.repeat(texts, count)
        keep = text[: n - size + 1] == text[size - 1 :]
        out.append(splitmix(total[keep]))
        own.append(text[: n - size + 1][keep])
    for t in np.flatnonzero((count > 0) & (count < size)):
        part = hashes[first[t] : first[t + 1]]
        total = U64(0)
        with np.errstate(over="ignore"):
            for j, h in enumerate(part):
                total = total + h * U64(pow(_C, j, 1 << 64))
            total = splitmix(np.array([total + U64(len(part))]))
        out.append(total)
        own.append(np.array([t]))
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(own)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = 5):
    """(sorted distinct shingle hashes, bounds): the set of text t is
    ``sets[bounds[t]:bounds[t + 1]]``."""
    starts, ends, first = words(raw, offsets)
    s, own = shingles(hash_spans(fold(raw), starts, ends), first, size)
    order = np.lexsort((s, own))
    s, own = s[order], own[order]
    if len(s):
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (own[1:] != own[:-1])
        s, own = s[new], own[new]
    return s, np.searchsorted(own, np.arange(len(offsets)), side="left")
