"""Best-fit packing of tokenised documents into sequences of bounded length, in bulk-synchronous rounds.

Pieces are range-sorted by length, longest first, so that each has a rank and each length a stretch of ranks. A length
is a whole number up to the capacity, so lengths with their stretches stand for any number of pieces, and so do gap
sizes with stretches of sequences. Each round sweeps the sorted lengths and gaps: a gap's successor match is the
longest piece left that fits it; where more gaps than pieces want a length (or the reverse) the lower ranks win; the
gaps that took a piece shrink and go into the next round, the others close. When no gap takes a piece, the longest
pieces left open as many sequences as their tokens need. The rounds work on at most one row per length and gap
stretch, whatever the number of documents; what they decide is then carried out on all pieces in their partitions.

Edge cases: a null text is an empty document (the end id alone); repeated rows are packed each; an empty table gives
no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.tokens import encoder, public_path

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Every document's ids and end id, cut into pieces of ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary, False), struct.pack("<I", end_id)
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), encode.ids(batch.column(1).to_pylist())):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    ids = data[at : at + 4 * capacity]
                    rows.append((doc_id, k, k * capacity, len(ids) // 4, zlib.crc32(ids)))
            columns = zip(*rows) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE_SCHEMA)


def ranked(found: DataFrame) -> DataFrame:
    """Pieces range-sorted by length, longest first, with their partition and place in it."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))], names=[*batch.schema.names, "part", "place"]
            )
            at += n

    order = [F.desc("length"), F.asc("doc_id"), F.asc("piece")]
    return found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{PIECE_SCHEMA}, part int, place long")


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Stretches (rank, first sequence, offset), sorted by rank, for counts of pieces by length; and the number of sequences.

    The piece of rank r, in the stretch that begins at rank s, goes to sequence (first sequence + r - s).
    """
    lengths = sorted(counts, reverse=True)
    rank = dict(zip(lengths, np.cumsum([0, *(counts[x] for x in lengths)]).tolist()))
    left = dict(counts)
    out: list[tuple[int, int, int]] = []
    opened = 0

    def take(length: int, n: int, sequence: int, offset: int) -> None:
        out.append((rank[length], sequence, offset))
        rank[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    gaps: list[tuple[int, int, int]] = []  # size, first sequence, sequences

    def open_with(length: int, n: int) -> None:
        nonlocal opened
        take(length, n, opened, 0)
        gaps.append((capacity - length, opened, n))
        opened += n

    for length in lengths:  # no two of these fit together
        if 2 * length > capacity:
            open_with(length, counts[length])
    while left:
        matched = True
        while matched and left:
            matched = False
            sizes = sorted(left)
            fitting: list[int] = []
            at, after = 0, []
            for size, sequence, n in sorted(gaps):
                while at < len(sizes) and sizes[at] <= size:
                    fitting.append(sizes[at])
                    at += 1
                while n and fitting:
                    length = fitting[-1]
                    k = min(n, left[length])
                    take(length, k, sequence, capacity - size)
                    if length not in left:
                        fitting.pop()
                    if size > length:
                        after.append((size - length, sequence, k))
                    sequence, n, matched = sequence + k, n - k, True
            gaps = after
        if left:
            gaps = []
            need = -(-sum(k * n for k, n in left.items()) // capacity)
            for length in sorted(left, reverse=True):
                n = min(need, left[length])
                open_with(length, n)
                need -= n
                if not need:
                    break
    return np.array(sorted(out), np.int64).reshape(-1, 3), opened


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    cut = written(pieces(docs, vocabulary or public_path("word_bpe_49k.json"), capacity, end_id), "pieces")
    rows = written(ranked(cut), "ranked-pieces")
    # Both are bounded: a row per length up to the capacity, and one per partition.
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    base = dict(zip((p for p, _ in parts), np.cumsum([0, *(n for _, n in parts)]).tolist()))
    stretches, _ = plan(counts, capacity)
    held = docs.sparkSession.sparkContext.broadcast((stretches, base))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches, base = held.value
        for batch in batches:
            part, at = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("part", "place"))
            rank = at + np.array([base[p] for p in part.tolist()], np.int64)
            row = np.searchsorted(stretches[:, 0], rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(stretches[row, 1] + rank - stretches[row, 0]), pa.array(stretches[row, 2])],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return rows.mapInArrow(place, f"{PIECE_SCHEMA}, sequence_id long, offset long")
