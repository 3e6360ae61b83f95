"""Vector best-fit packing of tokenised documents into sequences.

A document is tokenised once; only one longer than a sequence is cut, its first
piece taking the rest so that all others fill a sequence.  A bin has several
capacities: tokens, documents and attention cost (the sum of squared piece
lengths).  Pieces go, longest first, to the bin that fits best under every
constraint: the one of least weighted norm of what would be left, or of largest
weighted dot product of the piece and what is left.

Pieces of one length are alike, so the plan is made from their number alone: at
most one row per length reaches the driver, whatever the corpus holds.  Bins
in the same state are one entry with a multiplicity, so the plan's size
depends on the sequence length, not on the corpus.  Each piece then finds its
place by its length and its number among the pieces of that length (numbered
over all tasks by (doc_id, piece)).  All pieces are packed together; nothing
is lost at the borders of partitions.

Null texts count as empty: one piece of one token, the end mark.  Repeated
documents are packed as often as they occur.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shieldline.llm.tables import documents, extended, numbered, written
from shieldline.llm.tokens import Bpe, vocabulary


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds, how much each capacity weighs, and the rule."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"  # or "dot"

    def __post_init__(self) -> None:
        if self.documents < 1 or self.attention < self.tokens**2:
            raise ValueError("a full piece has to fit into an empty sequence")


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    first = (n - 1) % most + 1
    return [(0, first), *((s, most) for s in range(first, n, most))]


def pieces_of(docs: DataFrame, vocabulary_path: str, most: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of all pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))
    kind = dict(docs.dtypes)[id_col]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(shared.value)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(bpe.encode(batch.column(1))):
                for k, (s, n) in enumerate(cut(len(ids), most)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        encode, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(count: dict[int, int], cap: Capacity) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, from, number, sequence, offset): the pieces of ``length``
    numbered from ``from`` on go, one each, to the sequences from ``sequence``
    on, at ``offset``."""
    size = np.array([cap.tokens, cap.documents, cap.attention], dtype=np.float64)
    weight = np.array(cap.weights) / size
    left = np.zeros((0, 3))  # what is left in the bins of each state
    many: list[int] = []  # how many bins are in it
    held: list[tuple] = []  # what they hold, as a linked list of lengths
    for length in sorted(count, reverse=True):
        item = np.array([length, 1, length * length], dtype=np.float64)
        rest = count[length]
        while rest:
            fits = np.flatnonzero((left >= item).all(axis=1) & (np.array(many, dtype=np.int64) > 0)) if len(left) else []
            if len(fits):
                if cap.rule == "dot":
                    best = fits[np.argmin(-((left[fits] * weight) @ (item * weight)))]
                else:
                    best = fits[np.argmin((((left[fits] - item) * weight) ** 2).sum(axis=1))]
                n = min(rest, many[best])
                state, own = left[best], held[best]
                many[best] -= n
            else:
                each = int(np.min(size // item))
                n, state, own = max(1, rest // each), size, None
                for _ in range(min(each, rest) - 1):  # what the rule would do with pieces of one length
                    state, own, rest = state - item, (length, own), rest - n
            rest -= n
            left = np.vstack([left, state - item])
            many.append(n)
            held.append((length, own))
        if len(many) > 4096:  # drop the states that no bin is in
            alive = [i for i, n in enumerate(many) if n]
            left, many, held = left[alive], [many[i] for i in alive], [held[i] for i in alive]
    slots, taken, sequence = [], dict.fromkeys(count, 0), 0
    for n, own in zip(many, held):
        lengths = []
        while own:
            lengths.append(own[0])
            own = own[1]
        offset = 0
        for length in reversed(lengths) if n else ():
            slots.append((length, taken[length], n, sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    assert taken == count
    return slots


def pack(pieces: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset."""
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most one row per length
    slots = np.array(sorted(plan(counts, cap)), dtype=np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(slots)
    placed = numbered(pieces, ["length"], ["doc_id", "piece", "start"], "_rank")
    at = placed.columns.index("length"), placed.columns.index("_rank")
    kept = pieces.columns
    schema = extended(pieces, "sequence_id bigint, offset bigint")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        firsts = own[:, 0] << 44 | own[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in at)
            slot = own[np.searchsorted(firsts, length << 44 | rank, side="right") - 1] if len(length) else own[:0]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(kept))), pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])],
                names=[*kept, "sequence_id", "offset"])

    return placed.select(*kept, "_rank").mapInArrow(place, schema)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, vocabulary_path: str | None = None, cap: Capacity = Capacity()) -> DataFrame:
    cut_up = pieces_of(docs, vocabulary_path or public_vocabulary(), cap.tokens)
    return pack(written(cut_up, "pieces"), cap)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def pack_kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)
