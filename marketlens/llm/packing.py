"""Bulk-synchronous best-fit packing of documents into token sequences.

Documents are range-sorted by length, so all of one length are a run of ranks; open sequences
are kept by gap, so all of one gap are runs of sequence numbers. A round takes the longest
documents left, sweeps to the successor gap (the smallest that holds them), settles conflicts
by rank (the first ranks get the gap, the rest sweep on or open sequences), updates the gaps
and repeats. Rounds only handle runs: their number is bounded by the sequence length, whatever
the number of documents. Each document then finds its run by its rank in its own task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marketlens.llm.byte_bpe import byte_bpe
from marketlens.operators.ordering import number_rows
from marketlens.session import settle

def piece_bounds(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document of ``n`` ids: full pieces behind a first one with the rest."""
    first = n - (n - 1) // size * size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def _cut(path: str, end_id: int, size: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = byte_bpe(path), end_id.to_bytes(4, "little")
        for batch in batches:
            at, rows, parts = [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = bpe.encode(text.as_py()) + end
                for piece, (start, length) in enumerate(piece_bounds(len(ids) // 4, size)):
                    part = ids[4 * start:4 * (start + length)]
                    at.append(row)
                    rows.append((piece, start, length, zlib.crc32(part)))
                    if with_ids:
                        parts.append(np.frombuffer(part, "<u4").astype(np.int32))
            # Ids are copied as they are: through pandas a null beside them would make them doubles.
            columns = [batch.column("doc").take(pa.array(at, pa.int64()))]
            columns += [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.int64()] * 3))] if rows else [pa.array([], t) for t in (pa.int32(), *[pa.int64()] * 3)]
            names = ["doc", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(parts, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut


def token_pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, size: int = 1024, with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``size`` ids: doc, piece, start, length, ids_crc32 and, if asked for, ids."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    schema = "doc long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return plain.mapInArrow(_cut(tokenizer, end_id, size, with_ids), schema)


class Gaps:
    """Open sequences by gap: runs of (first sequence, count)."""

    def __init__(self):
        self._runs: dict[int, list[tuple[int, int]]] = {}
        self._sizes: list[int] = []

    def put(self, gap: int, first: int, count: int) -> None:
        if not count or not gap:
            return
        if gap not in self._runs:
            self._runs[gap] = []
            bisect.insort(self._sizes, gap)
        self._runs[gap].append((first, count))

    def successor(self, length: int) -> int | None:
        """The smallest gap that holds ``length``."""
        at = bisect.bisect_left(self._sizes, length)
        return self._sizes[at] if at < len(self._sizes) else None

    def take(self, gap: int, most: int) -> tuple[int, int]:
        """A run of at most ``most`` sequences with this gap."""
        runs = self._runs[gap]
        first, count = runs.pop()
        if count > most:
            runs.append((first + most, count - most))
        if not runs:
            del self._runs[gap]
            self._sizes.remove(gap)
        return first, min(count, most)


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Rounds of best-fit over runs: (length, first rank, count, first sequence, offset).

    Rank ``first rank + i`` goes to sequence ``first sequence + i`` at ``offset``.
    """
    gaps, out, opened = Gaps(), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            gap = gaps.successor(length)
            if gap is None:
                # As many new sequences as the documents left of this length need.
                gap, need = size, -(-left // (size // length))
                gaps.put(size, opened, need)
                opened += need
            fits = gap // length
            if left < fits:
                first, found, fits = *gaps.take(gap, 1), left
            else:
                first, found = gaps.take(gap, left // fits)
            for k in range(fits):
                out.append((length, rank, found, first, size - gap + k * length))
                rank += found
            left -= fits * found
            gaps.put(gap - fits * length, first, found)
    return out


def _placed(plan: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(plan), np.int64).reshape(-1, 5)
    keys = table[:, 0] << 42 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row_no", "length"))
            at = np.searchsorted(keys, length.astype(np.int64) << 42 | rank - 1, side="right") - 1
            others = [n for n in batch.schema.names if n != "row_no"]
            made = [pa.array(table[at, 3] + rank - 1 - table[at, 1], pa.int64()), pa.array(table[at, 4], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in others), *made], names=[*others, "sequence_id", "offset"])

    return place


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (``doc``, ``piece``, ``length``, ...).

    Sequences are filled from offset 0 without gaps. Every row is placed, repeated rows and
    null documents too; lengths are 1 to ``size``. An empty table gives no rows.
    """
    fixed = settle(pieces)
    counts = {r["length"]: r["count"] for r in fixed.groupBy("length").count().collect()}  # at most ``size`` rows
    ranked = number_rows(fixed, [F.col(c) for c in ("doc", "piece", "ids_crc32")], ["length"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("row_no").schema)
    return ranked.mapInArrow(_placed(best_fit(counts, size)), f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, size: int = 1024, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids), sequence_id, offset.

    A document is its ids and ``end_id``; null and empty texts are the end id alone. Only
    documents above ``size`` ids are cut, into full pieces behind a shorter first one.
    """
    return pack(token_pieces(docs, tokenizer, id_col, text_col, end_id, size, with_ids), size).withColumnRenamed("doc", id_col)
