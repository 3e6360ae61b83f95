"""MinHash near-duplicates by a multi-index Hamming join.

Documents are sets of two-word shingles.  Two of them link when their sets
overlap by 80 % or more of their union.

1. ``describe``: the set of a text gives a signature of ``POSITIONS`` minimal
   hashes, of each of which ``BITS`` bits are kept.  Texts of equal sets are one
   node (named by a 64-bit digest of the set).  Two signatures differ in a
   position with a probability of one minus the similarity at most.
2. Pigeonhole: signatures that differ in ``DISTANCE`` positions or fewer, cut
   into ``CHUNKS`` chunks, have a chunk with at most one difference, because
   DISTANCE < 2 * CHUNKS.  The allowed errors of a chunk are enumerated: for each
   of its positions, the chunk without that position is a key.  So every pair
   under the threshold shares a key, and a signature has POSITIONS keys.  A pair
   at a similarity of exactly 0.8 is beyond the threshold with a probability of
   5 in 100,000 (binomial), one at 0.85 in 2 of 10**9.
3. Pairs.  Nodes that share a key are a list.  First each node meets the least
   node among all its lists; links give components.  In lists that still hold
   several components, ``PIVOTS`` nodes meet those of other components within
   the threshold; then all pairs across components that are left meet, if their
   sizes and sketches of the sets (an exact bound) allow a link.  Pairs within a component are not
   needed, so a group of copies is never expanded into all its pairs, and
   nothing is capped.
4. Every pair is confirmed on the whole sets (40 bits of each shingle's hash).  Only
   texts that a fixed-size Bloom filter of the nodes in question lets through
   are tokenised for that; a full filter lets all through, which costs time only.

Hot groups: a list that holds a third of all nodes is aggregated before it is
shuffled; nodes in many pairs are salted when sets are sent to pairs; digests
and nodes of more than a thousandth of all rows are at most a thousand, and are
joined by broadcast.

Null and blank texts have no shingles, link with nothing and are their own
component.  A text of one word is one shingle.  Rows that repeat an id are
documents of their own.  Rows without an id take the component of the documents
they link with, or null, and are not kept.  Other columns are not looked at,
whatever their names.  Very long texts are one set like any other.  An empty
table gives no rows.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shieldline.llm.components import components, joined
from shieldline.llm.jaccard import PARITY_BITS, parity
from shieldline.llm.packed import pack_keys, unpack_keys
from shieldline.llm.tables import documents, written
from shieldline.llm.textarrays import U64, buffers, pieces, shingle_sets, splitmix

SHINGLE = 2
#: Similarity in hundredths: 100 * intersection >= SIMILAR * union.
SIMILAR = 80
POSITIONS, BITS = 96, 9
CHUNKS = 18
DISTANCE = 2 * CHUNKS - 1
#: Rounds in which one more node of each open list meets the others.
PIVOTS = 1
#: Bits of the filter of nodes at most (16 MB).
FILTER_BITS = 1 << 27

#: Positions are kept in lanes of BITS + 1 bits, the highest of which is free.
LANES = 60 // (BITS + 1)
LONGS = POSITIONS // LANES
_SIG = [f"s{i}" for i in range(LONGS)]
#: Sketches of whole sets that rule pairs out before they are confirmed.
_SKETCH = [f"p{i}" for i in range(PARITY_BITS // 64)]
_FULL = sum(((1 << BITS) - 1) << (BITS + 1) * k for k in range(LANES))
_HIGH = sum(1 << ((BITS + 1) * k + BITS) for k in range(LANES))
#: The positions of each chunk.
_CHUNKS = np.array_split(np.arange(POSITIONS), CHUNKS)
#: Nodes whose keys are made at once.
NODES = 1024
#: Bits of a shingle's hash that are dropped when sets are sent to be confirmed.
_DROPPED = U64(24)
#: The longs that are a chunk each: the first chunks, as long as they have as many positions as a long.
_ALONE = [s for s, c in zip(_SIG, _CHUNKS) if len(c) == LANES]
_XOR = splitmix(np.arange(1, POSITIONS + 1, dtype=U64) * U64(0xA24BAED4963EE407))
_ODD = splitmix(np.arange(1, POSITIONS + 1, dtype=U64) * U64(0x9FB21C651E98DF25)) | U64(1)


def signatures(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BITS bits of the least hash of every set (none empty) at each position."""
    out = np.empty((len(at) - 1, POSITIONS), dtype=np.uint16)
    for k in range(POSITIONS):
        least = np.minimum.reduceat((tokens ^ _XOR[k]) * _ODD[k], at[:-1])
        out[:, k] = splitmix(least) & U64((1 << BITS) - 1)
    return out


def lanes(signature: np.ndarray) -> np.ndarray:
    """Signatures as LONGS whole numbers each."""
    wide = signature.astype(np.int64).reshape(-1, LONGS, LANES)
    return (wide << np.arange(0, (BITS + 1) * LANES, BITS + 1)).sum(axis=2)


def positions(packed: np.ndarray) -> np.ndarray:
    wide = packed[:, :, None] >> np.arange(0, (BITS + 1) * LANES, BITS + 1)
    return (wide & ((1 << BITS) - 1)).reshape(len(packed), POSITIONS).astype(np.uint16)


def chunk_keys(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of every signature, each chunk without each of its positions,
    and a mark for each key: 26 bits of the whole chunk, the chunk's number, and
    in the lowest bit whether the key is the first of its chunk.  Signatures with
    equal chunks share all keys of the chunk; by the marks they meet at the first
    one only."""
    value = splitmix((signature.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + np.arange(POSITIONS, dtype=U64) * U64(0xD1B54A32D192ED03))
    keys, marks = np.empty((len(signature), POSITIONS), dtype=U64), np.empty((len(signature), POSITIONS), dtype=np.int32)
    for c, own in enumerate(_CHUNKS):
        whole = value[:, own].sum(axis=1)
        mark = (splitmix(whole) >> U64(38)).astype(np.int64) * 64 + 2 * c
        for p in own:
            keys[:, p] = splitmix(whole - value[:, p] + U64(int(p) + 1))
            marks[:, p] = (mark + (p == own[0])).astype(np.uint32).view(np.int32)
    return keys, marks


def distance(a: str, b: str) -> Column:
    """In how many positions the signatures ``a``_s0.. and ``b``_s0.. differ."""
    out = F.lit(0)
    for s in _SIG:
        apart = F.col(f"{a}_{s}").bitwiseXOR(F.col(f"{b}_{s}")) + F.lit(_FULL)
        out = out + F.bit_count(apart.bitwiseAND(F.lit(_HIGH)))
    return out


def _sets(texts):
    """(i, j, tokens, bounds) of runs of texts."""
    raw, offsets = buffers(texts)
    for i, j in pieces(offsets, 1 << 18):
        yield i, j, *shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SHINGLE)


def _given_back() -> None:
    """Memory that this worker has freed goes back to the system, where the C
    library can do that: executors have little beside their heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _node(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (null without shingles) and the signature."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, tokens, at in _sets(batch.column(1)):
                size = np.diff(at)
                some = np.flatnonzero(size)
                sig = np.zeros((j - i, LONGS), dtype=np.int64)
                if len(some):
                    sig[some] = lanes(signatures(tokens, np.append(at[:-1][some], len(tokens))))
                node = [_node(tokens[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(node, pa.int64()), *[pa.array(sig[:, k]) for k in range(LONGS)]],
                    names=["doc_id", "n_shingles", "node", *_SIG])
            _given_back()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        told, "doc_id bigint, n_shingles bigint, node bigint, " + ", ".join(f"{s} bigint" for s in _SIG))


def _entries(nodes: DataFrame, keep=None) -> DataFrame:
    """(key, node, mark) for every key of every node; with ``keep`` (a broadcast
    filter) of the keys that it lets through."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, NODES):
                part = batch.slice(i, NODES)
                packed = np.stack([part.column(1 + k).to_numpy() for k in range(LONGS)], axis=1)
                node = np.repeat(part.column(0).to_numpy(), POSITIONS)
                own, marks = (x.ravel() for x in chunk_keys(positions(packed)))
                own = own.view(np.int64)
                if keep is not None:
                    some = _held(keep.value, own)
                    own, node, marks = own[some], node[some], marks[some]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(node), pa.array(marks)], names=["key", "node", "mark"])
            _given_back()

    return nodes.select("node", *_SIG).mapInArrow(keys, "key bigint, node bigint, mark int")


def _thousandth(total: int) -> Column:
    """Of groups of ``n`` rows: those of more than a thousandth of the total, of
    which there are a thousand at most."""
    return F.col("n") * 1000 > total


# confirming pairs on whole sets


def _places(node: np.ndarray, bits: int) -> np.ndarray:
    """Two bits of the filter for every node."""
    own = node.view(U64)
    return (np.concatenate([splitmix(own ^ U64(0x632BE59BD9B4E019)), splitmix(own ^ U64(0xE220A8397B1DCDAF))]) % U64(bits)).astype(np.int64)


def _filter(rows: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of a column, of a fixed size at most, as 64-bit words."""
    n = rows.count()
    bits = min(FILTER_BITS, max(1 << 10, 1 << (16 * n).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy(), bits))
            word, first = np.unique(at >> 6, return_index=True)
            value = np.bitwise_or.reduceat(U64(1) << (at & 63).astype(U64), first) if len(at) else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["w", "b"])

    table = rows.select(column).mapInArrow(words, "w bigint, b bigint").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[table.column("w").to_numpy()] = table.column("b").to_numpy()
    return out


def _held(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values the filter may hold: all that are there, and few others."""
    place = _places(values, 64 * len(words))
    return (words[place >> 6] >> (place & 63) & 1).reshape(2, -1).all(axis=0)


def _whole_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, tokens and the parity sketch, once each, of the nodes asked for and
    of the few others that the filter lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(_filter(nodes, "node"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = sent.value, set()
        for batch in batches:
            for _, _, tokens, at in _sets(batch.column(0)):
                some = np.flatnonzero(np.diff(at))
                node = np.array([_node(tokens[at[k] : at[k + 1]]) for k in some], dtype=np.int64)
                hit = _held(words, node)
                own = [(n, tokens[at[k] : at[k + 1]]) for n, k in zip(node[hit].tolist(), some[hit]) if n not in seen and not seen.add(n)]
                if own:
                    sketch = np.stack([parity(t) for _, t in own])
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in own], pa.int64()), pa.array([pack_keys(t >> _DROPPED) for _, t in own], pa.binary()),
                                                      *[pa.array(sketch[:, k]) for k in range(len(_SKETCH))]], names=["node", "tokens", *_SKETCH])
            if len(seen) > 1_000_000:
                seen.clear()
            _given_back()

    return docs.select("text").mapInArrow(pack, "node bigint, tokens binary, " + ", ".join(f"{p} bigint" for p in _SKETCH)).dropDuplicates(["node"])


def _sent(pairs: DataFrame, side: str, sets: DataFrame, total: int) -> DataFrame:
    """``pairs`` with the set of ``side``; the sets of nodes in very many pairs
    are sent several times, to parts of their pairs."""
    other = "b" if side == "a" else "a"
    most = max(64, total // 1000)
    hot = pairs.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") > most).select(side, (F.col("n") / most + 1).cast("int").alias("_parts"))
    hot = F.broadcast(written(hot, "hot"))  # a thousand rows at most
    dealt = pairs.join(hot, side, "left").withColumn("_part", F.pmod(F.xxhash64(other), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    own = sets.select(F.col("node").alias(side), F.col("tokens").alias(f"t{side}")).join(hot, side, "left")
    own = own.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(own, [side, "_part"]).drop("_part")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), of a written table, whose whole sets overlap enough."""
    total = pairs.count()
    both = _sent(_sent(pairs, "a", sets, total), "b", sets, total).select("a", "b", "ta", "tb")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, x = [], None, None
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):  # sets one by one, not all of a batch
                if a != last:
                    last, x = a, unpack_keys(ta.as_buffer().to_pybytes())
                y = unpack_keys(tb.as_buffer().to_pybytes())
                joint = np.sort(np.concatenate([x, y]))
                shared = int((joint[1:] == joint[:-1]).sum())
                keep.append(100 * shared >= SIMILAR * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
            _given_back()

    return written(both.mapInArrow(confirm, "a bigint, b bigint"), "links")


# the join


def _open_lists(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (key, node, mark, c) of lists that hold several labels."""
    where = members.join(labels.toDF("node", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    several = where.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    return where.join(several, "key").select("key", "node", "mark", "c")


def _with(lists: DataFrame, known: DataFrame, columns: list[str], side: str) -> DataFrame:
    """Members under the names of ``side``, with set sizes and ``columns``."""
    own = known.select(F.col("node").alias(side), F.col("n_shingles").alias(f"{side}_n"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
    return lists.select("key", F.col("node").alias(side), F.col("mark").alias(f"{side}_mark"), F.col("c").alias(f"{side}_c")).join(own, side)


def _meet_here() -> Column:
    """Whether ``a`` and ``b`` differ in the chunk, or this is its first key."""
    return F.expr("(a_mark & 1) = 1 or a_mark <> b_mark")


def _not_before() -> Column:
    """Whether no earlier one of the chunks that are a long each is the same in
    ``a`` and ``b``: else they meet there."""
    out, chunk = F.lit(True), F.col("a_mark").bitwiseAND(F.lit(63))  # twice its number, and whether the key is its first
    for j, s in enumerate(_ALONE):
        out = out & ((chunk < 2 * j + 2) | (F.col(f"a_{s}") != F.col(f"b_{s}")))
    return out


def _fit() -> Column:
    """Sets of very different sizes cannot link."""
    return (F.col("a_n") * 100 >= F.col("b_n") * SIMILAR) & (F.col("b_n") * 100 >= F.col("a_n") * SIMILAR)


def _open_by_sketch() -> Column:
    """Whether the sketches leave it open that ``a`` and ``b`` link, an exact
    bound: sketches differ in no more bits than the sets in shingles, and sets of
    S shingles together that differ in D are (S - D) / (S + D) similar."""
    apart = F.lit(0)
    for p in _SKETCH:
        apart = apart + F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}")))
    return apart * (100 + SIMILAR) <= (F.col("a_n") + F.col("b_n")) * (100 - SIMILAR)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id (bigint), n_shingles and component_id (the smallest doc_id that
    links reach) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    told = written(describe(docs), "signatures")
    one = [F.first(c).alias(c) for c in ("n_shingles", *_SIG)]
    nodes = written(told.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), *one), "nodes")

    lists = written(_entries(nodes).groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a"), "lists")
    shared = docs.sparkSession.sparkContext.broadcast(_filter(lists, "key"))  # most keys have one node: they are not shuffled again
    members = written(_entries(nodes, shared).join(lists, "key").select("key", "node", "mark", "a"), "members")
    least = members.groupBy("node").agg(F.min("a").alias("a"))
    sets = written(_whole_sets(docs, least), "sets")
    signed = nodes.select("node", "n_shingles", *_SIG).join(sets.drop("tokens"), "node")
    sets = sets.select("node", "tokens")
    signed = written(signed, "signed")
    pairs = written(least.where("a < node").select("a", F.col("node").alias("b")), "met")
    links = _linked(pairs, sets)
    onward = links.select(F.col("a").alias("over"), F.col("b").alias("a"))
    labels = links.join(onward, "a", "left").select(F.col("b").alias("node"), F.coalesce("over", "a").alias("c"))  # what b, or what it hangs on, hangs on

    members = members.select("key", "node", "mark")
    for k in range(PIVOTS):
        left = written(_open_lists(members, labels), "open-lists")
        pivot = left.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "mark", "c")).alias("p")).select("key", "p.node", "p.mark", "p.c")
        far = (F.col("a_c") != F.col("b_c")) & _meet_here() & _fit() & (distance("a", "b") <= DISTANCE)
        meet = _with(left, signed, _SIG, "b").join(_with(pivot, signed, _SIG, "a"), "key").where(far)
        more = written(_ordered(meet).join(pairs, ["a", "b"], "left_anti"), "met")
        links = links.unionByName(_linked(more, sets))
        labels = written(components(links), "labels")
        pairs = pairs.unionByName(more)
    left = written(_open_lists(members, labels), "open-lists")
    across = _with(left, signed, _ALONE + _SKETCH, "a").join(_with(left, signed, _ALONE + _SKETCH, "b"), "key").where(
        (F.col("a_c") < F.col("b_c")) & _meet_here() & _not_before() & _fit() & _open_by_sketch())
    more = written(_ordered(across).join(pairs, ["a", "b"], "left_anti"), "met")
    roots = joined(labels, _linked(more, sets))

    # the smallest id of each component, and back to the rows
    named = nodes.select("node", "first", "n").join(roots.toDF("node", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    smallest = named.groupBy("c").agg(F.min("first").alias("component_id"))
    found = written(named.join(smallest, "c").select("node", "n", "component_id"), "found")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(found.where(_thousandth(total)).select("node", "component_id"))
    rows = told.select("doc_id", "n_shingles", "node")
    out = ["doc_id", "n_shingles", "component_id"]
    some = rows.where("node is not null")
    return (some.join(hot, "node").select(*out)
            .unionByName(some.join(hot, "node", "left_anti").join(found.select("node", "component_id"), "node").select(*out))
            .unionByName(rows.where("node is null").withColumn("component_id", F.col("doc_id")).select(*out)))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


OP11_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 2) - 1], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS other FROM both_ways UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
root AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(root.component_id, w.doc_id) AS component_id, coalesce(root.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)
"""
