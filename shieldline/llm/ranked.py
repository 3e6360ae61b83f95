"""Ranked lexical search over a length-stratified index.

A document of n terms has the normaliser m = 100 - 25 + ((25 n N) div L), with N
documents that hold terms and L terms in all.  A term that occurs tf times in it
adds w * ((1000000000 tf) div (1000 tf + 12 m)), so the part behind w (its
impact) depends on (tf, m) alone.

1. ``sizes`` counts terms, which gives N and L; ``hashed_terms`` turns each text
   into its m and its distinct term hashes with their tf.
2. ``build_index``: documents are dealt by m (strata of more than a thousandth of
   all documents over several tasks) and written in blocks of equal m.  A block lists its terms; for each term groups of
   equal tf, greatest last; for each group its documents.  Every document with a
   term is indexed, whatever is searched.
3. ``search``: items are searched in groups of ``ITEMS``, each against the whole
   index.  Weights come from the document frequencies that blocks add up.  A
   task takes blocks of up to ``WINDOW`` bytes, bounds what an item can score in
   each (each term at the block's greatest tf), visits blocks by falling bound,
   and leaves out the items whose bound is below their twentieth best score so
   far.  The impact is computed once for each tf of a block.  A sixteenth of the
   blocks is searched first, so that the others start from real scores.  The
   rows of all tasks are ranked at the end.

Bounds only skip blocks that cannot hold a result, so results are whole.  Terms
are compared by 64-bit hashes; a collision between a term of the items and one
of the corpus is possible in principle.

Null and empty texts hold no term, count nowhere and are never returned.  An
item without terms, or whose terms no document holds, has no rows.  Rows that
repeat a doc_id are documents of their own; rows that repeat an item_id are
items of their own, with equal item_id.  Documents without an id count in N, L
and df but cannot be returned.  Equal scores are ranked by doc_id.  Very long
texts are one document of a block.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shieldline.llm.tables import documents, written
from shieldline.session import scratch_path
from shieldline.llm.textarrays import U64, buffers, fold, hash_spans, pieces, words

TOP = 20
#: Documents of a block at most, and entries after which a block ends.
BLOCK_DOCS, BLOCK_ENTRIES = 4096, 1 << 18
#: Items searched at once, and bytes of blocks that a task orders at once.
ITEMS, WINDOW = 512, 16 << 20
#: One in so many blocks is searched first.
FIRST = 16

#: Bytes of terms: digits, letters and all beyond ASCII.
TERM = np.ones(256, dtype=bool)
for _a, _z in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    TERM[_a : _z + 1] = False


def term_counts(raw: np.ndarray, offsets: np.ndarray):
    """(hashes, tf, bounds, n): the distinct terms of text t, by hash, are
    ``hashes[bounds[t]:bounds[t + 1]]``; it has n[t] terms with repeats."""
    starts, ends, first = words(raw, offsets, TERM)
    h = hash_spans(fold(raw), starts, ends)
    n = np.diff(first)
    own = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(own[at], np.arange(len(n) + 1)), n


def sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(n, docs): how many documents have n terms (n above 0), written."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            for i, j in pieces(offsets):
                n = np.diff(words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], TERM)[2])
                n, times = np.unique(n[n > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(times, pa.int64())], names=["n", "docs"])

    counted = docs.select(text_col).mapInArrow(count, "n bigint, docs bigint")
    return written(counted.groupBy("n").agg(F.sum("docs").alias("docs")), "sizes")


def totals(counted: DataFrame) -> tuple[int, int]:
    """N and L: the documents that hold terms, and their terms."""
    sums = counted.agg(F.sum("docs").alias("n"), F.sum(F.col("n") * F.col("docs")).alias("total")).first()
    return sums.n or 0, sums.total or 0


def shares(counted: DataFrame, n: int, total: int) -> dict[int, int]:
    """Over how many tasks the documents of a large stratum are dealt: strata of
    more than a thousandth of all documents, of which there are a thousand at most."""
    strata = counted.groupBy(F.expr(f"75 + (25 * cast(n as decimal(38, 0)) * {n}) div {total}").cast("bigint").alias("m")).agg(F.sum("docs").alias("docs"))
    return {r.m: -(-1000 * r.docs // n) for r in strata.where(F.col("docs") * 1000 > n).collect()}


def hashed_terms(docs: DataFrame, n: int, total: int, dealt: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, m, share and the packed (hash, tf) of every text that holds a term."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for i, j in pieces(offsets, 1 << 20):
                h, tf, at, size = term_counts(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = np.flatnonzero(size)
                tf = tf.astype("<u4")
                m = [75 + 25 * x * n // total for x in size[rows].tolist()]
                share = [(r + turn) % dealt.get(x, 1) for r, x in zip(rows.tolist(), m)]
                turn += j - i
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows + i)), pa.array(m, pa.int64()), pa.array(share, pa.int32()),
                    pa.array([h[at[r] : at[r + 1]].tobytes() for r in rows], pa.binary()),
                    pa.array([tf[at[r] : at[r + 1]].tobytes() for r in rows], pa.binary())], names=["doc_id", "m", "share", "terms", "tf"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col)).mapInArrow(told, "doc_id bigint, m bigint, share int, terms binary, tf binary")


BLOCK = "m bigint, block bigint, docs array<bigint>, terms binary, term_end binary, tf binary, tf_end binary, posts binary"
_BLOCK_NAMES = [c.split()[0] for c in BLOCK.split(", ")]


def _block(m: int, ids: pa.Array, terms: list[bytes], tfs: list[bytes]) -> list:
    """One block: terms by hash, their groups by tf, the groups' documents."""
    size = [len(t) // 8 for t in terms]
    h, tf = np.frombuffer(b"".join(terms), U64), np.frombuffer(b"".join(tfs), "<u4")
    doc = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((doc, tf, h))
    h, tf, doc = h[order], tf[order], doc[order]
    group = np.ones(len(h), dtype=bool)
    group[1:] = (h[1:] != h[:-1]) | (tf[1:] != tf[:-1])
    at = np.flatnonzero(group)
    term = np.ones(len(at), dtype=bool)
    term[1:] = h[at][1:] != h[at][:-1]
    first = np.flatnonzero(term)
    ends = [np.append(first[1:], len(at)), np.append(at[1:], len(h))]
    number = int.from_bytes(h[:1].tobytes(), "little", signed=True) ^ len(h)
    return [m, number, ids, h[at][first].tobytes(), ends[0].astype("<u4").tobytes(), tf[at].tobytes(), ends[1].astype("<u4").tobytes(), doc.astype("<u2").tobytes()]


def build_index(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """The blocks of all documents (doc_id, text) that hold terms, given their
    ``sizes``, written; ``early`` marks those that are searched first."""
    n, total = totals(counted)
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 2_000_000)
    dealt = hashed_terms(docs, n, total, shares(counted, n, total)).repartition(parts, "m", "share").sortWithinPartitions("m")
    whole = [("m", pa.int64()), ("block", pa.int64()), ("docs", pa.list_(pa.int64())), *[(c, pa.binary()) for c in _BLOCK_NAMES[3:]]]
    schema = pa.schema(whole)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, terms, tfs, entries = None, [], [], [], 0

        def block():
            row = _block(last, ids, terms, tfs)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for i, t, f, m in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "terms", "tf", "m"))):
                if ids and (m != last or len(ids) == BLOCK_DOCS or entries >= BLOCK_ENTRIES):
                    yield block()
                    ids, terms, tfs, entries = [], [], [], 0
                last = m
                ids.append(i)
                terms.append(t)
                tfs.append(f)
                entries += len(t) // 8
        if ids:
            yield block()

    blocks = dealt.mapInArrow(build, BLOCK).withColumn("early", F.pmod(F.xxhash64("m", "block"), F.lit(FIRST)) == 0)
    path = scratch_path(spark, "index")
    blocks.write.partitionBy("early").parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


# searching


class Queries:
    """A group of items: entries (item, term, repeats, weight), sorted by term."""

    def __init__(self, ids: list, texts: list):
        raw, offsets = buffers(pa.array(texts, pa.string()))
        h, repeats, at, _ = term_counts(raw, offsets)
        item = np.repeat(np.arange(len(ids)), np.diff(at))
        order = np.argsort(h, kind="stable")
        self.ids = ids
        self.item, self.repeats = item[order], repeats[order].astype(np.int64)
        self.terms, self.first = np.unique(h[order], return_index=True)
        self.end = np.append(self.first[1:], len(h))
        self.weight = np.zeros(len(self.terms), dtype=np.int64)

    def weigh(self, df: dict[int, int], n: int) -> None:
        count = [df.get(t, 0) for t in self.terms.view(np.int64).tolist()]
        self.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for c in count], dtype=np.int64)


def _found(terms: bytes, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(places in the block's terms, places in the queries' terms) of common terms."""
    own = np.frombuffer(terms, U64)
    at = np.searchsorted(own, queries.terms)
    at[at == len(own)] = 0
    both = np.flatnonzero(own[at] == queries.terms)
    return at[both], both


def _impact(tf: np.ndarray, m: int) -> np.ndarray:
    return 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 12 * m)


class _Visit:
    """A block with what every item can score in it at most."""

    def __init__(self, row: dict, queries: Queries):
        self.m, self.docs, self.queries = row["m"], row["docs"], queries
        self.own, self.term = _found(row["terms"], queries)
        self.term_end = np.frombuffer(row["term_end"], "<u4").astype(np.int64)
        self.tf, self.tf_end = np.frombuffer(row["tf"], "<u4"), np.frombuffer(row["tf_end"], "<u4").astype(np.int64)
        self.posts = np.frombuffer(row["posts"], "<u2")
        most = _impact(self.tf[self.term_end[self.own] - 1], self.m) * queries.weight[self.term]
        self.bound = np.zeros(len(queries.ids), dtype=np.int64)
        size = queries.end[self.term] - queries.first[self.term]
        entry = _ranges(queries.first[self.term], size)
        np.add.at(self.bound, queries.item[entry], queries.repeats[entry] * np.repeat(most, size))

    def scores(self, active: np.ndarray) -> np.ndarray:
        """Scores of the active items (rows) and all documents (columns)."""
        q = self.queries
        row = np.full(len(q.ids), -1)
        row[active] = np.arange(len(active))
        out = np.zeros((len(active), len(self.docs)), dtype=np.int64)
        impact = _impact(np.arange(int(self.tf.max(initial=0)) + 1), self.m) if self.tf.max(initial=0) < 4096 else None
        for own, term in zip(self.own.tolist(), self.term.tolist()):
            entry = slice(q.first[term], q.end[term])
            rows = row[q.item[entry]]
            keep = rows >= 0
            if not keep.any():
                continue
            groups = slice(self.term_end[own - 1] if own else 0, self.term_end[own])
            ends = self.tf_end[groups]
            begin = self.tf_end[groups.start - 1] if groups.start else 0
            tf = self.tf[groups]
            each = q.weight[term] * (_impact(tf, self.m) if impact is None else impact[tf])
            docs = self.posts[begin : ends[-1]]
            out[rows[keep][:, None], docs[None, :]] += q.repeats[entry][keep][:, None] * np.repeat(each, np.diff(ends, prepend=begin))[None, :]
        return out


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + size[0] - 1, first[1] .., in one array."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


class _Best:
    """The best documents of every item so far: score falling, then doc_id."""

    def __init__(self, least: np.ndarray, top: int):
        self.least, self.top = least.copy(), top
        self.score: list = [np.zeros(0, np.int64) for _ in least]
        self.doc: list = [np.zeros(0, np.int64) for _ in least]

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        keep = scores >= max(1, self.least[item])
        if not keep.any():
            return
        s, d = np.concatenate([self.score[item], scores[keep]]), np.concatenate([self.doc[item], docs[keep]])
        order = np.lexsort((d, -s))[: self.top]
        self.score[item], self.doc[item] = s[order], d[order]
        if len(order) == self.top:
            self.least[item] = max(self.least[item], int(s[order[-1]]))


def _visit(window: list[dict], queries: Queries, best: _Best) -> None:
    visits = [_Visit(row, queries) for row in window]
    for v in sorted(visits, key=lambda v: -int(v.bound.max(initial=0))):
        active = np.flatnonzero((v.bound > 0) & (v.bound >= best.least))
        if not len(active):
            continue
        named = np.array([d is not None for d in v.docs])
        docs = np.array([-1 if d is None else d for d in v.docs], dtype=np.int64)
        scores = v.scores(active)
        for k, item in enumerate(active.tolist()):
            best.add(item, scores[k][named], docs[named])


def _searched(index: DataFrame, queries: Queries, least: np.ndarray, top: int) -> DataFrame:
    """(item, doc_id, score): of every task, the best documents of every item."""
    sent = index.sparkSession.sparkContext.broadcast((queries, least))  # at most ITEMS items

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, floor = sent.value
        best, window, size = _Best(floor, top), [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                window.append(row)
                size += len(row["terms"]) + len(row["tf"]) + len(row["posts"]) + 8 * len(row["docs"])
                if size >= WINDOW:
                    _visit(window, own, best)
                    window, size = [], 0
        _visit(window, own, best)
        count = [len(s) for s in best.score]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(count)), count), pa.int32()),
                                          pa.array(np.concatenate([*best.doc, np.zeros(0, np.int64)]), pa.int64()),
                                          pa.array(np.concatenate([*best.score, np.zeros(0, np.int64)]), pa.int64())], names=["item", "doc_id", "score"])

    return index.mapInArrow(search, "item int, doc_id bigint, score bigint")


def _frequencies(index: DataFrame, queries: Queries) -> dict[int, int]:
    """How many documents hold each term of the items."""
    sent = index.sparkSession.sparkContext.broadcast(queries.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        df = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for t, te, fe in zip(*(batch.column(c).to_pylist() for c in ("terms", "term_end", "tf_end"))):
                own = np.frombuffer(t, U64)
                at = np.searchsorted(own, terms)
                at[at == len(own)] = 0
                both = np.flatnonzero(own[at] == terms)
                stop = np.concatenate([[0], np.frombuffer(fe, "<u4")[np.frombuffer(te, "<u4").astype(np.int64) - 1]]).astype(np.int64)
                df[both] += (stop[1:] - stop[:-1])[at[both]]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(terms[some].view(np.int64)), pa.array(df[some])], names=["term", "df"])

    counted = index.select("terms", "term_end", "tf_end").mapInArrow(count, "term bigint, df bigint")
    return {r.term: r.df for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # at most the terms of ITEMS items


def _groups(items: DataFrame, size: int) -> Iterator[tuple[list, list]]:
    ids, texts = [], []
    for r in items.toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        if len(ids) == size:
            yield ids, texts
            ids, texts = [], []
    if ids:
        yield ids, texts


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``top`` best documents of
    each item; ``docs`` has doc_id (whole numbers) and text."""
    spark = docs.sparkSession
    kind = dict(items.dtypes)[item_col]
    counted = sizes(docs)
    n, _ = totals(counted)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    if not n:
        return out
    index = build_index(docs, counted)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    results = []
    for ids, texts in _groups(items.select(F.col(item_col), F.col(item_text)), ITEMS):
        queries = Queries(ids, texts)
        queries.weigh(_frequencies(index, queries), n)
        first = written(_searched(index.where("early"), queries, np.zeros(len(ids), np.int64), top), "found")
        last = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == top).select("item", "score").collect()
        least = np.zeros(len(ids), np.int64)
        for r in last:
            least[r.item] = r.score
        found = first.unionByName(_searched(index.where("not early"), queries, least, top))
        ranked = written(found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top), "ranked")
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
        results.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    for r in results:
        out = out.unionByName(r)
    return out


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY 1, 2),
wanted AS (SELECT item_id, t, count(*) AS q FROM b GROUP BY 1, 2),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, s WHERE t IN (SELECT t FROM b) GROUP BY 1),
scored AS (SELECT item_id, doc_id, CAST(sum(q * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * tf.n * s.n) // s.l))))) AS BIGINT) AS score
           FROM wanted JOIN weight USING (t) JOIN tf USING (t), s GROUP BY 1, 2),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
