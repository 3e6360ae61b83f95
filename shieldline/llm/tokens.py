"""Byte-level BPE over whole batches.

The vocabulary file of a public byte-level tokenizer is read on the driver and
broadcast (a few MB).  A batch is cut into pre-tokens for all its texts at
once; each distinct pre-token is encoded once and kept, so the encoder sees a
fraction of the text.  Texts with signs whose class differs between Unicode
versions, or with an apostrophe (contractions), go through the encoder whole.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from shieldline.llm.textarrays import buffers, hash_spans, pieces

#: How the tokenizer splits a text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points below this have settled classes.
SETTLED = 0x250
#: Distinct pre-tokens that a worker keeps; beyond it, it starts anew.
KEEP = 400_000

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _byte_of() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _classes() -> np.ndarray:
    table = np.full(SETTLED + 1, OTHER, dtype=np.uint8)
    for c in range(SETTLED):
        kind = unicodedata.category(chr(c))
        table[c] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else BLANK if chr(c).isspace() and c not in (0x1C, 0x1D, 0x1E, 0x1F) else OTHER
    return table


class Bpe:
    """An encoder with its store of known pre-tokens."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        of = _byte_of()
        ranks = {}
        for token, i in json.loads(vocabulary)["model"]["vocab"].items():
            if all(c in of for c in token):
                ranks[bytes(of[c] for c in token)] = i
        special = max(ranks.values()) + 1
        ranks = {t: i for t, i in ranks.items() if t != b"<|endoftext|>"}
        self.encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(special + 1, dtype=np.int64)
        for t, i in ranks.items():
            self.width[i] = len(t)
        self.classes = _classes()
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.begin = np.zeros(1 << 16, dtype=np.int64)
        self.size = np.zeros(1 << 16, dtype=np.int64)
        self.n, self.used = 1, 1  # entry 0: the id 0 that ends a text
        self.size[0] = 1

    def _add(self, keys: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(keys) > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[self.n : self.n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(keys)] = sizes
        self.known.update(zip(keys, range(self.n, self.n + len(keys))))
        self.n += len(keys)
        self.used += len(ids)

    def _learn(self, raw: bytes, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encodes new pre-tokens: those that begin with a blank and go on with
        another sign in one text (it splits where they meet), others alone."""
        blank = (ends - starts > 1) & (np.frombuffer(raw, np.uint8)[starts] == 32) & ~np.isin(np.frombuffer(raw, np.uint8)[np.minimum(starts + 1, len(raw) - 1)], (9, 10, 11, 12, 13, 32, 0xC2, 0xE1, 0xE2, 0xE3))
        together = np.flatnonzero(blank)
        if len(together):
            s, e = starts[together], ends[together]
            ids = np.array(self.encoder.encode_ordinary(b"".join(raw[a:b] for a, b in zip(s.tolist(), e.tolist())).decode()), dtype=np.int64)
            stop = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(e - s)) + 1
            self._add(keys[together].tolist(), ids, np.diff(stop, prepend=0))
        alone = np.flatnonzero(~blank)
        if len(alone):
            lists = [self.encoder.encode_ordinary(raw[a:b].decode()) for a, b in zip(starts[alone].tolist(), ends[alone].tolist())]
            self._add(keys[alone].tolist(), np.array([i for x in lists for i in x], dtype=np.int64), np.array([len(x) for x in lists]))

    def _plain(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = raw.tobytes()
        c = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # the byte where each code point begins
        first = np.searchsorted(at, offsets)
        kind = self.classes[c]
        new = np.zeros(len(c) + 1, dtype=bool)
        new[first] = True
        inside = ~new[1 : len(c)]
        begin = new[: len(c)].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        word = np.flatnonzero(begin[1:] & inside & (kind[1:] != BLANK) & (kind[:-1] == BLANK)) + 1  # after blanks
        begin[word - 1] = True
        begin[word[c[word - 1] == 32]] = False
        token = np.flatnonzero(begin)
        starts, ends = at[token], at[np.append(token[1:], len(c))]
        keys, where, place = np.unique(hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
        if self.n > KEEP:
            self._clear()
        found = np.array([self.known.get(k, -1) for k in keys.tolist()], dtype=np.int64)
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            self._learn(data, keys[fresh], starts[where[fresh]], ends[where[fresh]])
            found[fresh] = [self.known[k] for k in keys[fresh].tolist()]
        entry = np.insert(found[place], np.searchsorted(token, first[1:]), 0)
        size = self.size[entry]
        total = np.cumsum(size)
        ids = self.ids[np.repeat(self.begin[entry] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        stop = np.flatnonzero(entry == 0)
        return ids, np.concatenate([[0], total[stop]])

    def encode(self, column) -> list[np.ndarray]:
        """The ids of every text (null: empty), each followed by id 0."""
        raw, offsets = buffers(column)
        out: list[np.ndarray] = []
        for i, j in pieces(offsets, 1 << 20):
            part, own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            odd = (part == 39) | (part >= 0xCA)  # an apostrophe, or the first byte of a code point from U+0280 on
            odd |= np.append((part[:-1] == 0xC9) & (part[1:] >= 0x90), False) if len(part) else odd
            seen = np.concatenate([[0], np.cumsum(odd)])
            whole = seen[own[1:]] > seen[own[:-1]]
            if not whole.any():
                ids, stop = self._plain(part, own)
                out += np.split(ids, stop[1:-1])
                continue
            for k in range(j - i):
                text = part[own[k] : own[k + 1]]
                if whole[k]:
                    out.append(np.array([*self.encoder.encode_ordinary(text.tobytes().decode()), 0], dtype=np.uint32))
                else:
                    out.append(self._plain(text, np.array([0, len(text)]))[0] if len(text) else np.zeros(1, np.uint32))
        return out
