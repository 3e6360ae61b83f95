"""A Bloom filter of fixed size, built and asked as DataFrame operations.

``filter_of`` sets two bits for each key by a distributed aggregate; what it
returns has ``BITS`` / 64 rows at most, whatever the number of keys, so it can be
broadcast.  ``possibly`` marks the rows whose key it may hold: never false for a
key that is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most 2**21 words of 64 bits: 32 MB as rows of (word, bits).
BITS = 1 << 27
BITS_PER_KEY = 16


def _place(key: Column, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))


def size_for(n: int) -> int:
    """Bits for ``n`` keys: a power of two, ``BITS`` at most."""
    return min(BITS, max(1 << 10, 1 << (BITS_PER_KEY * max(n, 1) - 1).bit_length()))


def filter_of(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """(word, bits) of all keys that are not null."""
    places = F.explode(F.array(*[_place(F.col(column), k, bits) for k in (0, 1)])).alias("p")
    return keys.where(F.col(column).isNotNull()).select(places).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(_bit(F.col("p"))).alias("bits"))


def possibly(df: DataFrame, key: Column, words: DataFrame, bits: int, name: str) -> DataFrame:
    """``df`` with the boolean column ``name``: whether the filter may hold ``key``
    (false for a null one).  The filter is broadcast; no row of ``df`` moves."""
    out = df.withColumn("_p0", _place(key, 0, bits)).withColumn("_p1", _place(key, 1, bits))
    held = F.lit(True)
    for k in (0, 1):
        own = F.broadcast(words.select(F.col("word").alias(f"_w{k}"), F.col("bits").alias(f"_b{k}")))
        out = out.join(own, F.shiftright(f"_p{k}", 6) == F.col(f"_w{k}"), "left")
        held = held & (F.coalesce(F.col(f"_b{k}"), F.lit(0)).bitwiseAND(_bit(F.col(f"_p{k}"))) != 0)
    return out.withColumn(name, held & key.isNotNull()).drop(*[f"_{c}{k}" for c in "pwb" for k in (0, 1)])
