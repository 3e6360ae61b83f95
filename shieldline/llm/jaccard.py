"""N-gram Jaccard join with token-combination prefixes.

Documents are sets of five-word shingles ("tokens").  Two of them link when
their sets overlap by 80 % or more of their union.

1. Documents of equal sets are one representative, the one of least id.
2. Every token's document frequency is counted exactly over the corpus (up to
   48-bit hash collisions, which only touch the order): blocks and key ranges
   exchange packed counts (see ``packed``).  Tokens are ordered from rare to
   frequent.
3. With n tokens, a set shares at least t = ceil(0.8 n) with any partner, so
   the prefixes of n - t + l tokens of two linked sets share l tokens or more.
   Of these, tokens of at most ``RARE`` documents are indexed alone.  The
   frequent ones fall into b classes by hash, and pairs of tokens of one class
   are indexed: with l = b + 1 shared tokens, one of them is rare or one class
   holds two.  b and l depend on the band of the set's size alone (bands of
   ratio 1.25; a set is indexed in its own band and the next), so partners
   agree on them, and a set has a number of pairs in proportion to its size.
   In the smallest bands, where t < l, frequent tokens are also indexed alone.
4. Candidates.  In each list of the index, first every set is paired with the
   list's least id.  Pairs are verified on whole sets; links give components.
   In lists that still hold several components a few more members are paired
   with all of other components; then all pairs across components that are
   left are verified too, but for those that parity sketches of the sets prove
   too different (sketches differ in no more bits than the sets in tokens).  Pairs within a component are not needed, so a group
   of copies is never expanded into all its pairs, and no link between
   components is lost.

Nothing is capped: frequent tokens cost combinations, not omissions.  Null and
empty texts have no tokens, link with nothing and are their own component.  A
text of fewer than five words is one token.  Rows without an id take the
component of documents of the same set, or null.  Rows that repeat an id share
its component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shieldline.llm.components import components, joined
from shieldline.llm.packed import block_of, blocks_for, cuts, pack_keys, pack_values, unpack_keys, unpack_values
from shieldline.llm.tables import documents, written
from shieldline.llm.textarrays import U64, buffers, pieces, shingle_sets, splitmix

SHINGLE = 5
#: Similarity in hundredths: 100 * intersection >= SIMILAR * union.
SIMILAR = 80
RARE = 6
#: Rounds in which one more member of each open list is paired with the others.
PIVOTS = 1
#: Bits of the sketches that rule pairs out before they are verified.
PARITY_BITS = 1024

_SHORT = U64(16)  # 48 bits of a hash are counted and compared


def _sets(texts):
    """(i, j, tokens, bounds) of runs of texts."""
    raw, offsets = buffers(texts)
    for i, j in pieces(offsets):
        yield i, j, *shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SHINGLE)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and a 128-bit digest of the set (null if empty)."""
    kind = dict(docs.dtypes)["doc_id"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, told = [], []
            for i, j, tokens, at in _sets(batch.column(1)):
                size += np.diff(at).tolist()
                told += [_digest(tokens[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(told, pa.binary())], names=["doc_id", "n_shingles", "same"])

    return docs.select("doc_id", "text").mapInArrow(digest, f"doc_id {kind}, n_shingles bigint, same binary")


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _block_sets(texts, ids: list, skip: set):
    """Sets of a block's representatives: (ids, tokens, bounds)."""
    own, parts, sizes, seen = [], [], [], set()
    for i, j, tokens, at in _sets(texts):
        for k in range(i, j):
            a, b = at[k - i], at[k - i + 1]
            if b == a or ids[k] is None or (mark := _digest(tokens[a:b])) in seen or (ids[k], mark) in skip:
                continue
            seen.add(mark)
            own.append(ids[k])
            parts.append(tokens[a:b])
            sizes.append(b - a)
    return own, np.concatenate(parts) if parts else np.zeros(0, U64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _skipped(table) -> set:
    return {(i, s) for i, s in zip(table.column("doc_id").to_pylist(), table.column("same").to_pylist()) if s is not None}


_ASKED = "_range int, _block int, keys binary, counts binary"
_ASKED_ARROW = pa.schema([("_range", pa.int32()), ("_block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _request(ranges: int):
    def send(texts, skip):
        """The distinct tokens of a block and how many of its sets have them."""
        if not texts.num_rows:
            return _ASKED_ARROW.empty_table()
        _, tokens, _ = _block_sets(texts.column("text"), texts.column("doc_id").to_pylist(), _skipped(skip))
        keys, counts = np.unique(tokens >> _SHORT << _SHORT, return_counts=True)
        at = list(zip(cuts(keys, ranges)[:-1], cuts(keys, ranges)[1:]))
        block = texts.column("_block")[0].as_py()
        return pa.table({"_range": pa.array(range(ranges), pa.int32()), "_block": pa.array([block] * ranges, pa.int32()),
                         "keys": [pack_keys(keys[a:b] >> _SHORT) for a, b in at], "counts": [pack_values(counts[a:b].astype(U64)) for a, b in at]}, schema=_ASKED_ARROW)

    return send


_TOLD_ARROW = pa.schema([("_block", pa.int32()), ("_range", pa.int32()), ("counts", pa.binary())])


def _merge(table):
    """For each block of a range, the corpus frequency of each of its tokens."""
    keys = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    counts = [unpack_values(x) for x in table.column("counts").to_pylist()]
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts).astype(np.float64)).astype(U64) if len(place) else np.zeros(0, U64)
    stops = np.cumsum([len(k) for k in keys])
    return pa.table({"_block": table.column("_block"), "_range": table.column("_range"),
                     "counts": [pack_values(np.minimum(total[place[s - len(k) : s]], U64(0xFFFFFFFF))) for k, s in zip(keys, stops)]}, schema=_TOLD_ARROW)


#: Least sizes of the bands, exact powers of 1.25.
_BANDS = np.array([-(-(5**k) // 4**k) for k in range(160)], dtype=object)
_BAND_STARTS = np.array([min(int(x), 2**62) for x in _BANDS], dtype=np.int64)


def band_of(n: int) -> int:
    return int(np.searchsorted(_BAND_STARTS, n, side="right")) - 1


def classes_of(band: int) -> int:
    """Classes of frequent tokens in a band: in proportion to its sizes."""
    return max(4, int(min(1.25 ** (band + 1), 2.0**40) * 0.05))


def least_overlap(n: int) -> int:
    return -(-SIMILAR * n // 100)


def prefix(n: int, band: int) -> int:
    return min(n, n - least_overlap(n) + classes_of(band) + 1)


def small(band: int) -> bool:
    """Whether a set indexed in the band could share fewer tokens than l."""
    return least_overlap(max(1, int(min(1.25 ** (band - 1), 2.0**40)))) < classes_of(band) + 1


def index_keys(tokens: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """The keys under which a set is indexed; tokens are ordered from rare to
    frequent, equal ones by hash."""
    n = len(tokens)
    band = band_of(n)
    most = max(prefix(n, band), prefix(n, band + 1))
    shared = frequency > 1
    rare = shared & (frequency <= RARE)
    out = [splitmix(tokens[:most][rare[:most]])]
    for g in (band, band + 1):
        p, b = prefix(n, g), classes_of(g)
        own = np.sort(tokens[:p][(shared & ~rare)[:p]])
        if small(g):
            out.append(splitmix(own))
        if len(own) < 2:
            continue
        cls = (splitmix(own ^ U64(0x5851F42D4C957F2D)) % U64(b)).astype(np.int64)
        order = np.argsort(cls, kind="stable")
        own, cls = own[order], cls[order]
        size = np.bincount(cls, minlength=b)
        last = np.repeat(np.cumsum(size), size)  # where each token's class ends
        more = last - np.arange(len(own)) - 1  # later tokens of its class
        a = np.repeat(np.arange(len(own)), more)
        z = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(more) - more, more)
        out.append(splitmix(own[a] * U64(0x9E3779B97F4A7C15) + splitmix(own[z] + U64(g + 1))))
    return np.unique(np.concatenate(out))


_INDEXED_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("tokens", pa.binary())])


def _index(texts, told):
    """Index keys and the packed set of each representative that shares a token
    of its prefix with another one."""
    if not texts.num_rows:
        return _INDEXED_ARROW.empty_table()
    ids, tokens, at = _block_sets(texts.column("text"), texts.column("doc_id").to_pylist(), _skipped(told))
    answers = sorted((r, c) for r, c in zip(told.column("_range").to_pylist(), told.column("counts").to_pylist()) if c is not None)
    counts = np.concatenate([unpack_values(c) for _, c in answers] or [np.zeros(0, U64)]).astype(np.int64)
    short = tokens >> _SHORT
    if not len(tokens):
        return _INDEXED_ARROW.empty_table()
    frequency = counts[np.searchsorted(np.unique(short), short)]
    size = np.diff(at)
    text = np.repeat(np.arange(len(ids)), size)
    order = np.lexsort((tokens, frequency, text))
    tokens, frequency = tokens[order], frequency[order]
    most = np.array([max(prefix(int(n), g := band_of(int(n))), prefix(int(n), g + 1)) for n in size])
    inside = np.arange(len(tokens)) - at[text] < most[text]
    linked = np.unique(text[inside & (frequency > 1)])
    rows = []
    for k in linked.tolist():
        a, b = at[k], at[k + 1]
        keys = index_keys(tokens[a:b], frequency[a:b])
        short = np.sort(tokens[a:b] >> _SHORT)
        rows.append((ids[k], b - a, keys.view(np.int64), parity(short), pack_keys(short)))
    cols = list(zip(*rows)) if rows else [[], [], [], [], []]
    return pa.table({"id": pa.array(cols[0], pa.int64()), "n": pa.array(cols[1], pa.int64()), "keys": pa.array(cols[2], pa.list_(pa.int64())),
                     "sketch": pa.array(cols[3], pa.list_(pa.int64())), "tokens": pa.array(cols[4], pa.binary())}, schema=_INDEXED_ARROW)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets overlap enough."""
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b").select("a", "b", "ta", "tb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if ta != last:
                    last, x = ta, unpack_keys(ta)
                y = unpack_keys(tb)
                joint = np.sort(np.concatenate([x, y]))
                shared = int((joint[1:] == joint[:-1]).sum())
                keep.append(100 * shared >= SIMILAR * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(verify, "a bigint, b bigint")


def _sizes_fit(a: str, b: str):
    """Sets of very different sizes cannot link."""
    return (F.col(a) * 100 >= F.col(b) * SIMILAR) & (F.col(b) * 100 >= F.col(a) * SIMILAR)


def parity(tokens: np.ndarray) -> np.ndarray:
    """For each of PARITY_BITS hash values, whether an odd number of tokens has
    it.  Two sketches differ in at most as many bits as the sets in tokens."""
    odd = np.bincount((splitmix(tokens) % U64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_link(n: tuple[str, str], sketch: tuple[str, str]):
    """Whether sizes and sketches leave it open that two sets link: an exact
    bound, so no link is lost.  D tokens that only one set has and S in both
    sizes together mean a similarity of (S - D) / (S + D)."""
    apart = F.aggregate(F.zip_with(*sketch, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, v: a + v)
    return _sizes_fit(*n) & (apart * (100 + SIMILAR) <= (F.col(n[0]) + F.col(n[1])) * (100 - SIMILAR))


def _open_lists(entries: DataFrame, roots: DataFrame, sketches: DataFrame) -> DataFrame:
    """The entries (key, id, n, c, sketch) of lists that hold several components."""
    where = entries.join(roots.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    several = where.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    return where.join(several, "key").select("key", "id", "n", "c").join(sketches, "id")


def similarity_components(docs: DataFrame) -> DataFrame:
    """doc_id (bigint), n_shingles and component_id of every row of ``docs``
    (doc_id, text); other columns are not looked at."""
    docs = docs.select("doc_id", "text")
    told = written(describe(docs), "sets")
    groups = told.where("same is not null").groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    groups = groups.where("n > 1 and first is not null").select("same", "first")  # the sets of several rows
    blocks = blocks_for(docs)
    place = block_of("doc_id", blocks)
    dealt = docs.withColumn("_block", place)
    copies = written(told.where("same is not null").join(groups, "same").where("doc_id <> first").select("doc_id", "same", place.alias("_block")).distinct(), "copies")
    asked = dealt.groupBy("_block").cogroup(copies.groupBy("_block")).applyInArrow(_request(blocks), _ASKED)
    answers = asked.groupBy("_range").applyInArrow(_merge, "_block int, _range int, counts binary")
    answers = answers.select("_block", "_range", "counts", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("same"))
    answers = answers.unionByName(copies.select("_block", F.lit(-1).alias("_range"), F.lit(None).cast("binary").alias("counts"), "doc_id", "same"))
    indexed = written(dealt.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(_index, "id bigint, n bigint, keys array<bigint>, sketch array<bigint>, tokens binary"), "index")

    entries = indexed.select(F.explode("keys").alias("key"), "id", "n")
    least = entries.groupBy("key").agg(F.min(F.struct("id", "n")).alias("least"), F.count("*").alias("lists")).where("lists > 1")
    stars = entries.join(least.select("key", F.col("least.id").alias("a"), F.col("least.n").alias("na")), "key")
    pairs = written(stars.where((F.col("a") < F.col("id")) & _sizes_fit("na", "n")).select("a", F.col("id").alias("b")).distinct(), "pairs")
    links = written(_verified(pairs, indexed), "pair-links")
    roots = written(components(links), "roots")
    sketches = indexed.select("id", "sketch")

    # lists that still hold several components: more pivots, then what is left across them
    for k in range(PIVOTS):
        left = written(_open_lists(entries, roots, sketches), "open-lists")
        pivot = left.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(k)), "id", "n", "c", "sketch")).alias("p")).select("key", "p.*")
        meet = left.join(pivot.toDF("key", "_h", "a", "na", "ca", "sa"), "key").where((F.col("c") != F.col("ca")) & _may_link(("na", "n"), ("sa", "sketch")))
        more = meet.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        more = written(more, "pairs")
        roots = joined(roots, written(_verified(more, indexed), "pair-links"))
        pairs = pairs.unionByName(more)
    left = written(_open_lists(entries, roots, sketches), "open-lists")
    x, y = (left.select("key", *[F.col(c).alias(f"{c}{s}") for c in ("id", "n", "c", "sketch")]) for s in "xy")
    across = x.join(y, "key").where((F.col("cx") < F.col("cy")) & _may_link(("nx", "ny"), ("sketchx", "sketchy")))
    more = across.select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    roots = joined(roots, written(_verified(written(more, "pairs"), indexed), "pair-links")).withColumnRenamed("id", "first")

    found = told.join(groups, "same", "left").withColumn("first", F.coalesce("first", "doc_id"))
    return found.join(roots, "first", "left").select("doc_id", "n_shingles", F.coalesce("component", "first").alias("component_id"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(documents(spark, sf_dir))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of least id;
    of rows that repeat its id, one.  Documents without words are no group and
    stay.  Of documents without an id one of each text stays, unless a document
    with an id has that text."""
    found = similarity_components(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = written(found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "repeated")
    once = named.join(twice, "doc_id", "left_anti").select(*docs.columns)
    repeated = named.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    bare = docs.where("doc_id is null")
    if not bare.take(1):
        return once.unionByName(repeated)
    hashed = bare.withColumn("_text", F.sha2("text", 256)).where("_text is not null").dropDuplicates(["_text"])
    known = docs.where("doc_id is not null").select(F.sha2("text", 256).alias("_text")).join(hashed.select("_text"), "_text", "left_semi").distinct()
    return (once.unionByName(repeated).unionByName(hashed.join(known, "_text", "left_anti").select(*docs.columns))
            .unionByName(bare.where("text is null")))


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS other FROM both_ways UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
root AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(root.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)
"""
