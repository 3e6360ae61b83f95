"""Document fingerprints: bottom-k sketches of shingle hashes, in SQL functions.

A sketch holds the ``K`` smallest 64-bit hashes of a text's distinct five-word
shingles (a text of fewer words, but not none, is one shingle; lower case,
words end at blanks).  The sketch of a union is the bottom k of the sketches'
union, so sketches of parts merge.  Resemblance is the share of the union's
bottom k that both sketches hold; containment and the distinct count follow
from it and from the k-th smallest hash.

Null and empty texts have an empty sketch; two empty sketches are alike (1),
an empty and a full one are not (0).  Everything here is a column expression
or a DataFrame operation on the JVM; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shieldline.llm.tables import documents

K = 128
SHINGLE = 5
#: Text bytes of one task of the ordered pass over neighbours.
TASK_BYTES = 24 << 20


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words, repeats included."""

    def runs(w: Column) -> Column:
        every = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, size))))
        return F.when(F.size(w) >= size, F.slice(every, 1, F.greatest(F.size(w) - (size - 1), F.lit(0)))).when(
            F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return _let(word_hashes(text), runs)


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, size))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of what two sketches were made of, together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets (0 to 1)."""
    both = _let(merged(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has (0 to 1; an empty a: 1)."""
    shared = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(shared, F.lit(1.0)))


def as_text(a: Column) -> Column:
    """A sketch as fixed-width hexadecimal digits."""
    return F.concat_ws("", F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))


def from_text(s: Column) -> Column:
    """The sketch that ``as_text`` wrote."""
    count = (F.length(s) / 16).cast("int")
    signed = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.conv(F.substring(s, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint"))
    return F.when(F.length(s) == 0, F.array().cast("array<bigint>")).otherwise(signed)


def merge_groups(df: DataFrame, by: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """One sketch per group.  Equal hashes of a group meet first, spread over
    all tasks by (group, hash); what each task then hands on is its bottom k."""
    hashes = df.select(*by, F.explode(sketch_col).alias("_h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_h"))
    least = hashes.withColumn("_r", rank).where(F.col("_r") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(sketch_col))


def _bucket(of: Column, bounds: list[int]) -> Column:
    """Number of ascending bounds that are not above ``of``; null counts as least.
    Bounds are searched in two levels, so the cost is their number's root."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    array = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= of))
    coarse = F.greatest(below(array([r[0] for r in rows])) - 1, F.lit(0))
    return F.when(of.isNull(), 0).otherwise(
        _let(coarse, lambda c: c * width + below(F.get(F.array(*map(array, rows)), c))))


def with_next(df: DataFrame, id_col: str, cols: list[str], tasks: int) -> DataFrame:
    """``df`` with next_<col> of the row that follows by ``id_col`` (after the
    last: the first).  Rows are dealt into ``tasks`` ranges of ids, and the
    first row of each range is also handed to the range before it, so each row
    moves once and no range sees another one's rest.  Rows without an id come
    first; repeated ids are ordered by a hash of the columns."""
    cuts = df.agg(F.percentile_approx(id_col, [i / tasks for i in range(1, max(tasks, 2))], 100000).alias("c")).first().c
    dealt = df.withColumn("_bucket", _bucket(F.col(id_col), sorted(set(cuts or [])) if tasks > 1 else []))
    heads = dealt.groupBy("_bucket").agg(F.min(F.struct(F.col(id_col))).alias("_head"))  # at most ``tasks`` rows
    order = Window.orderBy("_bucket")
    last = F.max("_bucket").over(Window.partitionBy())
    heads = heads.select(F.col(f"_head.{id_col}").alias("_head"), F.coalesce(F.lag("_bucket").over(order), last).alias("_before"))
    own = dealt.withColumn("_guest", F.lit(0))
    guests = own.join(F.broadcast(heads), F.col(id_col).eqNullSafe(F.col("_head"))).withColumns(
        {"_bucket": F.col("_before"), "_guest": F.lit(1)}).select(own.columns)
    line = Window.partitionBy("_bucket").orderBy("_guest", id_col, F.xxhash64(*cols))
    both = own.unionByName(guests)
    return (both.withColumns({f"next_{c}": F.lead(c).over(line) for c in cols})
            .where("_guest = 0").drop("_bucket", "_guest"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    pairs = with_next(docs, "doc_id", ["text"], tasks)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    prints = pairs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("text")).alias("a"), sketch(F.col("edited")).alias("b"), sketch(F.col("next_text")).alias("c"))
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("b")).alias("near_edited"), resemblance(F.col("a"), F.col("c")).alias("near_next"),
        distinct_shingles(F.col("a")).alias("distinct_shingles"))
