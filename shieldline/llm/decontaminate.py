"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised to lower-case words joined by single
spaces, and every run of ten words (or the whole item if it has fewer) is one
pattern of the automaton.  A document is normalised the same way and scanned
once; matches are mapped back to character offsets of the original text.

The benchmark is configuration beside the corpus, but its size is checked: its
items are dealt by hash into parts of at most ``PART_BYTES``; each part is one
broadcast, and each batch of documents is scanned by the automaton of each part
in turn.  A usual benchmark is one part, so its text is scanned once.

Nulls and empty texts have no words and no hits; repeated items count as
several items; items without an id are looked for like any other and stand in
``items`` together as one null, the last; an empty benchmark gives no hits; documents keep their other
columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shieldline.llm.tables import aside, documents, extended, restored

WINDOW = 10
PART_BYTES = 32 << 20

#: Lower-cases A-Z and blanks every byte outside 0-9, a-z and \x80-\xFF.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _patterns(items: list[tuple[str | None, str]], window: int) -> dict[str, tuple[int, list[str | None]]]:
    """Normalised window -> (its words, the items that hold it)."""
    found: dict[str, tuple[int, list[str | None]]] = {}
    for item, text in items:
        w = item_words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if size else ():
            key = (b" " + b" ".join(w[i : i + size]) + b" ").decode("latin-1")
            own = found.setdefault(key, (size, []))[1]
            if not own or own[-1] != item:
                own.append(item)
    return found


def _automaton(items: list[tuple[str | None, str]], window: int):
    import ahocorasick

    found = _patterns(items, window)
    if not found:
        return None
    a = ahocorasick.Automaton()
    for key, (size, own) in found.items():
        a.add_word(key, (len(key), size, own))
    a.make_automaton()
    return a


_built: list[tuple] = []


def _built_once(part, window: int):
    """The automaton of a broadcast part; a worker keeps the last one."""
    if not (_built and _built[0][0] is part and _built[0][1] == window):
        _built[:] = [(part, window, _automaton(part.value, window))]
    return _built[0][2]


def scan_words(tokens: list[bytes], automata) -> tuple[list[tuple[int, int]], set[str | None]]:
    """Merged word ranges that are hit, and the items with occurring windows."""
    line = (b" " + b" ".join(tokens) + b" ").decode("latin-1")
    spans, items = [], set()
    blanks = None
    for a in automata:
        if a is None:
            continue
        for end, (length, size, own) in a.iter(line):
            if blanks is None:
                blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
            first = int(np.searchsorted(blanks, end - length + 1))
            spans.append((first, first + size))
            items.update(own)
    return _merge(spans), items


def _by_id(item: str | None) -> tuple[bool, str]:
    """Order of item ids, null last."""
    return item is None, item or ""


def _parts(benchmark: DataFrame, id_col: str, text_col: str, part_bytes: int) -> list:
    """Broadcasts of at most about ``part_bytes`` of items each."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(size / part_bytes))
    sc = benchmark.sparkSession.sparkContext
    out = []
    for k in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        out.append(sc.broadcast(sorted(((r.i, r.t) for r in own.toLocalIterator()), key=lambda x: (_by_id(x[0]), x[1]))))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted item ids as strings, null last) and
    spans ("start:end" characters of the original text, end exclusive)."""
    parts = _parts(benchmark, item_col, item_text, part_bytes)
    added = ["n_words", "n_hit", "items", "spans"]
    kept = [c for c in docs.columns if c not in added]
    out = docs.select(*kept)
    schema = extended(out, "n_words bigint, n_hit bigint, items array<string>, spans array<string>")
    place = kept.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            texts = batch.column(place).to_pylist()
            words = [item_words(text) for text in texts]
            hits, owners = [[] for _ in texts], [set() for _ in texts]
            for p in parts:  # part by part, so that an automaton is built once for a batch at most
                automaton = _built_once(p, window)
                for k, tokens in enumerate(words):
                    more, has = scan_words(tokens, [automaton])
                    hits[k] = _merge(hits[k] + more) if hits[k] else more
                    owners[k] |= has
            for text, tokens, hit, own in zip(texts, words, hits, owners):
                n_words.append(len(tokens))
                n_hit.append(sum(e - s for s, e in hit))
                items.append(sorted(own, key=_by_id))
                spans.append(_offsets(text, hit) if hit else [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.string()))], names=[*kept, *added])

    return out.mapInArrow(scan, schema)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged


def _offsets(text: str, hit: list[tuple[int, int]]) -> list[str]:
    """Word ranges as character offsets of the original text."""
    at = [m.span() for m in _WORD.finditer(text.translate(_ASCII))]
    return [f"{at[s][0]}:{at[e - 1][1]}" for s, e in hit]


_ASCII = {c: c + 32 for c in range(65, 91)}


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark window."""
    names = ["n_words", "n_hit", "items", "spans"]
    found = find_contamination(aside(docs, names), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return restored(found.where("n_hit = 0").drop(*names)).select(*docs.columns)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(it, ',' ORDER BY it) AS its FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS it FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
