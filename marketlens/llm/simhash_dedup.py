"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. Each is read as a word of the perfect binary
(23, 12) Golay code and decoded to the indices of nearby codewords: the centre of its sphere,
and, for words three errors away from it, the five further codewords at distance four. Two
words that differ in at most two bits always share an index (tested for every error pattern).

Fingerprints within four bits have errors e1 <= e2 <= e3 with e1 + e2 <= 2 in the three
segments, so some pair of segments has at most two errors each: the keys are the pairs of
indices of each pair of segments. Rows that share a key meet in a bucket, are verified with
the exact distance and give links; connected links are classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from marketlens.llm.links import CELL, cell_bounds, cells, components, forest, whole_cells
from marketlens.session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
_SPACE = dict.fromkeys(range(0x09, 0x0E), " ")
#: Widths of the three segments; their sum is the width of a fingerprint.
SEGMENTS = (22, 21, 21)
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Hashes looked at together, so that a long text needs no large table of bits.
_STEP = 1 << 15


# ---- Golay code -------------------------------------------------------------------------


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word modulo the generator."""
    rest = np.asarray(words, np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


@cache
def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome, the errors that lead to the keyed codewords, and how many there are.

    One error of weight up to three for every syndrome (the code is perfect); where it has
    weight three, also the five errors of weight four.
    """
    table, count, weight = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64), np.zeros(2048, np.int64)
    for w in range(5):
        errors = np.array([sum(1 << i for i in c) for c in combinations(range(23), w)], np.int64)
        for s, e in zip(syndrome(errors).tolist(), errors.tolist()):
            if w < 4 or weight[s] == 3:
                table[s, count[s]], weight[s] = e, w if w < 4 else 3
                count[s] += 1
    return table, count


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) indices (the upper twelve bits of each nearby codeword) and how many hold."""
    table, count = error_patterns()
    s = syndrome(words)
    return (np.asarray(words, np.int64)[:, None] ^ table[s]) >> 11, count[s]


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of 64-bit fingerprints: (row, key), key = pair of segments and two indices."""
    prints = prints.view(np.uint64)
    parts, low = [], 0
    for width in SEGMENTS:
        parts.append(golay_indices((prints >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)))
        low += width
    rows, keys = [], []
    for pair, (x, y) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        for i in range(6):
            for j in range(6):
                holds = np.flatnonzero((parts[x][1] > i) & (parts[y][1] > j))
                rows.append(holds)
                keys.append(pair << 24 | parts[x][0][holds, i] << 12 | parts[y][0][holds, j])
    return np.concatenate(rows), np.concatenate(keys)


# ---- fingerprints -----------------------------------------------------------------------


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of one text as a signed 64-bit number."""
    found = (text or "").translate(_FOLD).translate(_SPACE).split(" ")
    found = [w for w in found if w]
    if not found:
        return 0
    whole = " ".join(found).encode()
    ends = np.cumsum([len(w.encode()) + 1 for w in found]).tolist()
    starts = [0, *ends[:-1]]
    n = max(1, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _STEP):
        hashes = [digest(whole[a:b - 1], 42) for a, b in zip(starts[at:min(n, at + _STEP)], ends[min(words, len(found)) - 1 + at:])]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > n)
    return int(packed.view(">u8")[0].astype(np.uint64).view(np.int64)) if len(packed) == 8 else 0


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4, out: str = "_print") -> DataFrame:
    """``docs`` without ``text``, with the fingerprint as a long in ``out``."""
    @F.pandas_udf(T.LongType())
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.withColumn(out, prints(F.col(text))).drop(text)


# ---- links and classes ------------------------------------------------------------------


def _keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        prints = frame["print"].to_numpy(np.int64)
        for at in range(0, len(prints), 2000):
            part = prints[at:at + 2000]
            rows, keys = golay_keys(part)
            yield pd.DataFrame({"key": keys.astype(np.int32), "print": part[rows]})


def _verified(bits: int):
    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count((x ^ y).view(np.uint64)) <= bits

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_cells(frames, "key"):
            prints, own = frame["print"].to_numpy(np.int64), frame["_own"].to_numpy()
            across = (frame["_i"] != frame["_j"]).to_numpy()
            bounds = cell_bounds(frame, "key")
            last = np.repeat(bounds[1:], np.diff(bounds))
            u, v = [], []
            # Small cells: all rows of the frame against the row k further on.
            small = np.repeat(np.diff(bounds) <= 64, np.diff(bounds))
            at = np.flatnonzero(small)
            for k in range(1, 64):
                at = at[at + k < last[at]]
                if not len(at):
                    break
                hit = at[near(prints[at], prints[at + k]) & (~across[at] | (own[at] != own[at + k]))]
                u.append(prints[hit]), v.append(prints[hit + k])
            for c in np.flatnonzero(np.diff(bounds) > 64):
                a, b = bounds[c], bounds[c + 1]
                left = range(a, b)
                for i in left[::256]:
                    x = prints[i:min(b, i + 256)]
                    hit = near(x[:, None], prints[None, a:b])
                    if across[a]:
                        hit &= own[i:i + len(x), None] != own[None, a:b]
                    p, q = np.nonzero(hit)
                    p, q = forest(x[p], prints[a:b][q]) if len(p) else (x[:0], x[:0])
                    u.append(p), v.append(q)
            if u and sum(map(len, u)):
                p, q = forest(np.concatenate(u), np.concatenate(v))
                yield pd.DataFrame({"u": p, "v": q})

    return links


def print_links(prints: DataFrame, bits: int = 4, block: int = 2048) -> DataFrame:
    """Links (u, v) that connect distinct fingerprints (``print``) as their pairs within ``bits`` do.

    Not every pair is emitted: within a cell a spanning forest carries the same components.
    """
    if bits > 4:
        raise ValueError("the keys of three segments are complete for up to four bits")
    keyed = prints.select("print").mapInPandas(_keyed, "key int, print long")
    met = cells(keyed, "key", F.col("print"), block).select("key", "print", *CELL)
    return met.mapInPandas(_verified(bits), "u long, v long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4, block: int = 2048,
) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id among the documents reached over links of at most
    ``bits`` differing bits. Null, empty and blank texts have fingerprint zero and link like
    any other; repeated rows stay repeated; rows without an id belong to their class but never
    name it (a class without ids has a null ``component_id``). An empty table gives no rows;
    other columns are not read. Equal fingerprints are one node, so a group of copies costs
    one row however large it is.
    """
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    known = settle(fingerprints(plain, "_text", words))
    nodes = settle(known.groupBy(F.col("_print").alias("print")).agg(F.min("_id").alias("_least")))
    roots = components(print_links(nodes, bits, block))
    classed = nodes.join(roots, F.col("print") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "print"))
    least = classed.groupBy("_root").agg(F.min("_least").alias("component_id")).withColumnRenamed("_root", "_class")
    named = classed.join(least, F.col("_root") == F.col("_class")).select("print", "component_id")
    return known.join(named, F.col("_print") == F.col("print")).select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_print")), 16, "0").alias("fingerprint"), "component_id"
    )
