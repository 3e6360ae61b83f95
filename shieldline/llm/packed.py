"""Packed key exchange: counting keys over the whole corpus in few rows.

Texts are dealt into blocks.  A block sends its distinct 64-bit keys as packed
byte strings, one for each range of the key space; a range merges what all
blocks sent and answers each block with one value per key.  A key that fills a
third of the corpus is still one entry per block, so no key is hot, and the
number of shuffled rows is blocks times ranges, whatever the number of keys.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes of a block at most, on average.
BLOCK_BYTES = 12 << 20


def blocks_for(docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES, least: int | None = None) -> int:
    """How many blocks the texts are dealt into: by their size, and ``least``
    (two for each shuffle partition) at least."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    if least is None:
        least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // block_bytes))


def block_of(id_col: str, blocks: int):
    return F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")


def cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where ascending keys cross from one range to the next."""
    step = (1 << 64) // ranges
    return np.concatenate([[0], np.searchsorted(keys, np.arange(1, ranges, dtype=np.uint64) * np.uint64(step)), [len(keys)]])


def _planes(a: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = data[: n * width].reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64)


def _width(a: np.ndarray) -> int:
    return max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)


def pack_values(a: np.ndarray) -> bytes:
    """Non-negative integers, in as many bytes each as the largest needs."""
    if not len(a):
        return b""
    w = _width(a)
    return bytes([w]) + _planes(a, w)


def unpack_values(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(data, np.uint8)
    return _from_planes(raw[1:], (len(raw) - 1) // int(raw[0]), int(raw[0]))


def pack_keys(a: np.ndarray) -> bytes:
    """Ascending keys, as the differences between them."""
    if not len(a):
        return b""
    return int(a[0]).to_bytes(8, "little") + pack_values(np.diff(a))


def unpack_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    first = np.array([int.from_bytes(data[:8], "little")], dtype=np.uint64)
    return np.cumsum(np.concatenate([first, unpack_values(data[8:])]), dtype=np.uint64)
