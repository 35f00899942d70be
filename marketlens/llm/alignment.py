"""Alignment of the tokens of two tokenizers over the same texts.

A text with a space in front is encoded by a byte-level BPE (A) and by a piece model (B), whole.
The cumulative byte ends of both sides go into dictionaries from end to index; the ends that both
have, sorted, cut the two id lists into groups, and inside a group every pair of tokens whose
byte ranges overlap is a link. Each text is encoded once: its links are written beside its
numbers, as packed pairs of ids.

How often two ids are linked is counted over all documents. The most frequent pairs (at most
``frequent``, so their table has a fixed size) are looked up in the tasks that read the links;
the links of all other pairs are joined with the counts by pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from marketlens.llm.byte_bpe import byte_bpe
from marketlens.llm.sentencepiece_codec import MARK, Vocabulary
from marketlens.llm.written import written

#: A pair of ids as one number: A's id times this, plus B's id.
PAIR = 1 << 32
#: Bytes of links in one batch on their way out.
BATCH = 1 << 22


#: What stands behind an id: within a group, at the end of its A ids, at its own end.
_MARKS = (",", "|", ";")


@cache
def _names(size: int) -> np.ndarray:
    """Decimal ids below ``size`` with each of the marks behind them, mark by mark."""
    return np.array([f"{i}{mark}" for mark in _MARKS for i in range(size)], object)


class Aligned:
    """Ids of both sides of a text, the tokens at which its groups end, and the linked ids."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray):
        self.a, self.b = a, b
        a_at = dict(zip(a_ends.tolist(), range(len(a))))
        # B's ends are looked up in their order, so the index on its side is the place in the row.
        shared = np.fromiter(map(a_at.get, b_ends.tolist(), repeat(-1)), np.int64, len(b))
        self._common = shared >= 0
        self.a_cuts, self.b_cuts = shared[self._common] + 1, np.flatnonzero(self._common) + 1
        # A B token is linked with the A tokens from the one at its first byte to the one at its
        # last. Along all links the A token moves on by one, but where the next B token begins
        # inside of it, it stays.
        at_end = np.searchsorted(a_ends, b_ends)
        stays = np.concatenate([[0], np.cumsum(~self._common[:-1])])
        widths = np.diff(at_end + stays, prepend=-1)
        steps = np.arange(len(a) + len(b) - len(self.a_cuts)) - np.repeat(stays, widths)
        self.links = a[steps] * PAIR + np.repeat(b, widths)

    def groups_text(self) -> str:
        """``a1,a2|b1;a3|b2,b3``: decimal ids of the groups in order."""
        # Behind the A tokens of a group stand its B tokens.
        a_last = np.zeros(len(self.a), np.int64)
        a_last[self.a_cuts - 1] = 1
        b_last = self._common.astype(np.int64)
        a_place = np.arange(len(self.a)) + np.concatenate([[0], self.b_cuts])[np.cumsum(a_last) - a_last]
        b_place = np.arange(len(self.b)) + self.a_cuts[np.cumsum(b_last) - b_last]
        size = 1 << int(max(self.a.max(), self.b.max())).bit_length()
        named = np.empty(len(self.a) + len(self.b), np.int64)
        named[a_place] = self.a + a_last * size
        named[b_place] = self.b + b_last * (2 * size)
        return "".join(_names(size)[named].tolist())[:-1]


class Aligner:
    """Encodes texts on both sides and aligns them."""

    def __init__(self, a_path: str, b_path: str):
        self._a, self._b, v = byte_bpe(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path), Vocabulary(b_path)
        a_bytes = self._a.pieces()
        self._a_size = np.zeros(max(a_bytes) + 1, np.int64)
        for i, piece in a_bytes.items():
            self._a_size[i] = len(piece)
        self._b_bytes = [p.replace(MARK, " ").encode() for p in v.pieces]
        for byte, i in enumerate(v.byte_ids):
            self._b_bytes[i] = bytes([byte])
        self._b_size = np.array([len(p) for p in self._b_bytes], np.int64)

    def align(self, text: str | None) -> Aligned | None:
        """None if the text is empty or the bytes of a side's tokens are not those of space and text."""
        if not text:
            return None
        raw = (" " + text).encode()
        b = self._b.EncodeAsIds(text)
        if b"".join(map(self._b_bytes.__getitem__, b)) != raw:
            return None
        a = self._a.plain_ids(" " + text)
        a, b = np.fromiter(a, np.int64, len(a)), np.fromiter(b, np.int64, len(b))
        a_ends = np.cumsum(self._a_size[a])
        # Byte-level tokens are the bytes of the text in order: they differ from it only by bytes left out.
        if a_ends[-1] != len(raw):
            return None
        return Aligned(a, b, a_ends, np.cumsum(self._b_size[b]))


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per process."""
    return Aligner(a_path, b_path)


def _pack(links: np.ndarray) -> bytes:
    """Two bytes an id where both ids fit, else four."""
    a, b = links >> 32, links & PAIR - 1
    if len(links) == 0 or max(a.max(), b.max()) < 1 << 16:
        return b"\2" + np.stack([a, b]).astype("<u2").tobytes()
    return b"\4" + np.stack([a, b]).astype("<u4").tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    a, b = np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64).reshape(2, -1)
    return a * PAIR + b


_ALIGNED = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "links": pa.binary()}


def aligned_texts(rows: DataFrame, a_path: str, b_path: str, text_col: str = "_text") -> DataFrame:
    """Replaces the text by ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` and packed ``links``."""
    others = [f for f in rows.schema if f.name != text_col]
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)

        def out(batch: pa.RecordBatch, start: int, found: list[tuple]) -> pa.RecordBatch:
            kept = [batch.column(n).slice(start, len(found)) for n in names]
            return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(zip(*found), _ALIGNED.values()))], names=[*names, *_ALIGNED])

        for batch in batches:
            start, found, held = 0, [], 0
            for text in batch.column(text_col):
                one = both.align(text.as_py())
                if one is None:
                    found.append((0, 0, 0, 0, "", _pack(np.empty(0, np.int64))))
                else:
                    digest = hashlib.sha256(one.groups_text().encode()).hexdigest()
                    found.append((len(one.a), len(one.b), len(one.a_cuts), len(one.links), digest, _pack(one.links)))
                held += len(found[-1][-1])
                if held >= BATCH:
                    yield out(batch, start, found)
                    start, found, held = start + len(found), [], 0
            if found:
                yield out(batch, start, found)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return rows.mapInArrow(run, f"{schema}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary")


def _counted(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their times."""
    found, at = np.unique(codes, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, at, times)
    return found, sums


def pair_counts(aligned: DataFrame, flush: int = 1 << 19) -> DataFrame:
    """(pair, n): how many links of all rows hold the pair.

    Counts are combined in the task that reads the links and go out whenever ``flush`` pairs are held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda codes, times: pa.RecordBatch.from_arrays([pa.array(codes), pa.array(times)], names=["pair", "n"])
        codes, times, held = [], [], 0
        for batch in batches:
            for packed in batch.column(0):
                more, counts = np.unique(_unpack(packed.as_py()), return_counts=True)
                codes.append(more)
                times.append(counts)
                held += len(more)
                if held >= flush:
                    found, sums = _counted(np.concatenate(codes), np.concatenate(times))
                    if len(found) >= flush // 2:
                        yield out(found, sums)
                        codes, times, held = [], [], 0
                    else:
                        codes, times, held = [found], [sums], len(found)
        if held:
            yield out(*_counted(np.concatenate(codes), np.concatenate(times)))

    return aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _looked_up(aligned: DataFrame, table) -> DataFrame:
    """Replaces the links by ``n_best`` and ``count_sum`` over the frequent pairs, and the ``rare`` pairs."""
    others = [f for f in aligned.schema if f.name != "links"]
    names = [f.name for f in others]
    struct = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = table.value
        for batch in batches:
            rows = []
            for packed in batch.column("links"):
                codes, times = np.unique(_unpack(packed.as_py()), return_counts=True)
                at = np.searchsorted(pairs, codes)
                there = at < len(pairs)
                there[there] = pairs[at[there]] == codes[there]
                at, n = at[there], times[there]
                rare = [{"pair": p, "times": t} for p, t in zip(codes[~there].tolist(), times[~there].tolist())]
                rows.append((int(n[best[at]].sum()), int((n * counts[at]).sum()), rare))
            made = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), struct))]
            if rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], names=[*names, "n_best", "count_sum", "rare"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return aligned.mapInArrow(run, f"{schema}, n_best long, count_sum long, rare array<struct<pair: long, times: long>>")


def align(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = 1 << 18,
) -> DataFrame:
    """One row per row: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A pair's count is the number of links in all rows that hold it; ``n_best`` are the links
    whose count is the highest of their B id (ties included), ``count_sum`` is the sum of the
    counts of a row's links. Strings of special tokens are plain text. Null and empty texts, and
    texts that a side cannot give back byte for byte (with U+2581 in them), have no tokens: zeros
    and an empty digest. Repeated rows count and stay; a null id stays null, ids are not
    converted. Texts are encoded whole, in time about proportional to their length. An empty
    table gives no rows; other columns are not read.
    """
    plain = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    rows = plain.withColumns({f"_r{s}": F.xxhash64(F.lit(s), F.col("_doc").isNull(), "_doc", "_text") for s in (1, 2)})
    aligned = written(aligned_texts(rows, a_path, b_path), "aligned")
    counts = written(pair_counts(aligned), "pair-counts")
    # At most as many rows as B has ids.
    b_id = F.pmod("pair", F.lit(PAIR))
    top = counts.groupBy(b_id.alias("_b")).agg(F.max("n").alias("_top"))
    ranked = written(counts.join(top, b_id == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_top")).alias("best")), "pairs")
    common = ranked.orderBy(F.col("n").desc(), "pair").limit(frequent).toPandas().sort_values("pair")  # at most ``frequent`` rows
    table = docs.sparkSession.sparkContext.broadcast(tuple(common[c].to_numpy(t) for c, t in (("pair", np.int64), ("n", np.int64), ("best", np.bool_))))

    scored = written(_looked_up(aligned, table), "scored")
    # Rows equal in id and text have equal pairs, which are looked up once.
    rare = scored.where(F.size("rare") > 0).select("_r1", "_r2", F.inline("rare")).distinct()
    late = rare.join(ranked, "pair").groupBy("_r1", "_r2").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum")
    )
    done = scored.drop("rare").join(late, ["_r1", "_r2"], "left")
    more = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
    return done.select(
        F.col("_doc").alias(id_col), "n_a", "n_b", "n_groups", "n_links", more("n_best", "_best"), more("count_sum", "_sum"), "groups_sha256",
    )
