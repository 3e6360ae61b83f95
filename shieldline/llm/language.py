"""Language ID by rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to three
letters, words padded by blanks) of a language, most frequent first.  A
document's own list is compared with every profile by the out-of-place
distance: the sum, over the document's n-grams, of how far each one's rank is
from its rank in the profile, or the full length of a profile where it is not
found.  The language of least distance wins.

Counts cover all training rows: each task counts whole batches, and one
aggregation sums them per language.  Only the profiles (``TOP`` n-grams for
each learned language) reach the driver and are broadcast; ``TOP`` times the
number of languages is their bound, and ``LANGUAGES`` bounds the latter with an
error beyond it.

A null text or one without a letter gives ``und`` and score 0; so does an
empty training table.  Equal counts rank by the n-gram, equal distances by the
language's name.  Other columns are kept, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shieldline.llm.tables import aside, documents, extended, remainder, restored
from shieldline.llm.textarrays import buffers, pieces

TOP = 400
LANGUAGES = 2000
#: Least score of a document that the pipeline keeps.
LEAST = 0.05

_BITS = 21


_table = np.zeros(0, dtype=np.int32)


def _letters(most: int) -> np.ndarray:
    """For every code point up to ``most``: its lower-case letter, or a blank."""
    global _table
    if len(_table) <= most:
        size = min(sys.maxunicode + 1, max(1 << 10, 1 << int(most).bit_length()))
        table = np.full(size, 32, dtype=np.int32)
        for c in range(size):
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _table = table
    return _table


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, text numbers, alphabet): an n-gram is a number whose digits,
    in base len(alphabet), stand for letters of this batch; 0 stands for none.
    Numbers ascend as the n-grams written out in full do."""
    joined = "".join(f" {t} " if t else "  " for t in texts)
    size = np.array([len(t) + 2 if t else 2 for t in texts])
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letters(int(c.max(initial=0)))[c]
    own = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    blank = c == 32
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (own[1:] == own[:-1]))
    c, own = c[keep], own[keep]
    seen = np.zeros(int(c.max(initial=0)) + 1, dtype=np.int32)
    seen[c] = 1
    alphabet = np.concatenate([[0], np.flatnonzero(seen)])
    if len(alphabet) ** 3 >= 1 << 31:
        seen = seen.astype(np.int64)
    seen[alphabet[1:]] = np.arange(1, len(alphabet))
    blank, c = c == 32, seen[c]
    base = c.dtype.type(len(alphabet))
    same = own[:-1] == own[1:]
    two = same & ~(blank[:-1] & blank[1:])
    three = same[:-1] & same[1:] & ~blank[1:-1]
    pair = c[:-1] * base + c[1:]
    grams = np.concatenate([c[~blank], pair[two], (pair[:-1] * base + c[2:])[three]])
    return grams, np.concatenate([own[~blank], own[:-1][two], own[:-2][three]]), alphabet


def _counted(grams: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, written out in full, and their counts."""
    if len(alphabet) ** 3 <= 1 << 21:
        n = np.bincount(grams)
        g = np.flatnonzero(n)
        n = n[g]
    else:
        g, n = np.unique(grams, return_counts=True)
    return _full(g, alphabet), n


def _full(g: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    base = len(alphabet)
    return (alphabet[g // base**2] << 2 * _BITS) | (alphabet[g // base % base] << _BITS) | alphabet[g % base]


def _text(gram: int) -> str:
    out = ""
    while gram:
        out = chr(gram & ((1 << _BITS) - 1)) + out
        gram >>= _BITS
    return out


def count_grams(train: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows of ``train`` with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, g: np.ndarray, n: np.ndarray) -> None:
            if lang in total:
                a, b = total[lang]
                both, place = np.unique(np.concatenate([a, g]), return_inverse=True)
                total[lang] = both, np.bincount(place, np.concatenate([b, n]), len(both)).astype(np.int64)
            else:
                total[lang] = g, n.astype(np.int64)

        def rows():
            for lang, (g, n) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in set(langs):
                texts = batch.column(0).filter(pa.array(langs == lang))
                _, offsets = buffers(texts)
                texts = texts.to_pylist()
                for i, j in pieces(offsets):
                    g, _, alphabet = _grams(texts[i:j])
                    add(lang, *_counted(g, alphabet))
            if sum(len(g) for g, _ in total.values()) > 1 << 21:  # many scripts: hand on what is there
                yield from rows()
                total.clear()
        yield from rows()

    some = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    return some.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(train: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> dict[str, list[str]]:
    """language -> its n-grams, most frequent first."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = count_grams(train, text_col, lang_col).withColumn("rank", rank).where(F.col("rank") <= top)
    profiles: dict[str, dict[int, int]] = {}
    for r in rows.toLocalIterator():
        profiles.setdefault(r.lang, {})[r.rank] = r.gram
        if len(profiles) > LANGUAGES:
            raise ValueError(f"more than {LANGUAGES} languages to learn")
    return {lang: [_text(g) for _, g in sorted(own.items())] for lang, own in sorted(profiles.items())}


def _code(gram: str) -> int:
    n = 0
    for c in gram:
        n = n << _BITS | ord(c)
    return n


class _Profiles:
    """The profiles as arrays: all their n-grams, and each one's rank in each language."""

    def __init__(self, profiles: dict[str, list[str]], top: int):
        self.langs, self.top = list(profiles), top
        self.grams = np.array(sorted({_code(g) for own in profiles.values() for g in own}), dtype=np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int32)
        for k, own in enumerate(profiles.values()):
            for rank, g in enumerate(own):
                self.ranks[np.searchsorted(self.grams, _code(g)), k] = rank

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of every text."""
        n, m = len(texts), len(self.langs)
        grams, own, alphabet = _grams(texts)
        if not len(grams) or not m:
            return ["und"] * n, np.zeros(n)
        # distinct n-grams of each text, most frequent first, equal counts by n-gram
        wide = len(alphabet) ** 3
        pair = np.sort(own * np.int64(wide) + grams)
        start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        count, pair = np.diff(start, append=len(pair)), pair[start]
        text, gram = pair // wide, pair % wide
        order = np.lexsort((-count, text))  # stable: n-grams already ascend
        text, gram = text[order], gram[order]
        first = np.searchsorted(text, np.arange(n + 1))
        rank = np.arange(len(text)) - first[text]
        keep = rank < self.top
        text, gram, rank = text[keep], _full(gram[keep], alphabet), rank[keep]
        at = np.searchsorted(self.grams, gram)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != gram] = len(self.grams)
        size = np.bincount(text, minlength=n)
        distance = np.empty((n, m))
        for k in range(m):
            known = self.ranks[at, k]
            away = np.where(known < 0, self.top, np.abs(known - rank))
            distance[:, k] = np.bincount(text, np.minimum(away, self.top), n)
        best = distance.argmin(axis=1)
        most = np.maximum(size, 1) * self.top
        score = 1 - distance[np.arange(n), best] / most
        some = size > 0
        return [self.langs[b] if s else "und" for b, s in zip(best, some)], np.where(some, score, 0.0)


def predict_language(docs: DataFrame, profiles: dict[str, list[str]], text_col: str = "text", top: int = TOP) -> DataFrame:
    """``docs`` with lang_pred and score (1: all n-grams at their profile's ranks)."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*kept)
    place = kept.index(text_col)
    schema = extended(out, "lang_pred string, score double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _Profiles(shared.value, top)
        for batch in batches:
            _, offsets = buffers(batch.column(place))
            texts, langs, scores = batch.column(place).to_pylist(), [], []
            for i, j in pieces(offsets):
                a, b = model.predict(texts[i:j])
                langs += a
                scores.append(b)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)]), pa.float64())], names=[*kept, "lang_pred", "score"])

    return out.mapInArrow(predict, schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = learn_profiles(docs.where(remainder("doc_id", 4) != 2))
    return (predict_language(docs.select("doc_id", "text"), profiles)
            .select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a learned language: ``und`` and those too far from
    every profile go."""
    profiles = learn_profiles(docs.where(remainder("doc_id", 4) != 2))
    if not profiles:  # nothing to compare with: only what has no letter goes
        return docs.where(F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    found = predict_language(aside(docs, ["lang_pred", "score"]), profiles)
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST)).drop("lang_pred", "score")
    return restored(found).select(*docs.columns)
