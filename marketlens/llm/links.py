"""Similarity buckets of any size, and connected components over links.

A bucket is a key that similar rows share. Buckets above ``block`` rows are cut into cells
(pairs of blocks), so that no task ever holds more than two blocks of one key and yet every
pair of a bucket meets in exactly one cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marketlens.session import settle

#: Columns that :func:`cells` adds: block of the row and the two blocks of the cell.
CELL = ("_own", "_i", "_j")


def cells(rows: DataFrame, key: str, salt: Column, block: int) -> DataFrame:
    """Rows once per cell of their bucket, partitioned by cell and sorted by ``key`` and cell.

    A bucket of up to ``block`` rows is the single cell (0, 0). A larger one gets
    ``ceil(n / block)`` blocks by a hash of ``salt``; a row of block b goes to the cells (b, j)
    of all blocks j.
    """
    # Only keys above a block are joined: every row is met once per block of its key.
    large = rows.groupBy(key).count().where(F.col("count") > block).select(
        F.col(key).alias("_key"), F.ceil(F.col("count") / F.lit(block)).cast("int").alias("_blocks")
    )
    blocks = F.coalesce("_blocks", F.lit(1))
    own = F.pmod(F.xxhash64(salt, F.lit(1)), blocks).cast("int")
    cell = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda j: F.struct(F.least(j, F.col("_own")).alias("_i"), F.greatest(j, F.col("_own")).alias("_j")),
    )
    met = (
        rows.join(large, F.col(key) == F.col("_key"), "left").withColumn("_own", own)
        .withColumn("_cell", F.explode(cell)).select(*rows.columns, "_own", "_cell._i", "_cell._j")
    )
    return met.repartition(key, "_i", "_j").sortWithinPartitions(key, "_i", "_j")


def whole_cells(frames: Iterator[pd.DataFrame], key: str, rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """Regroups a sorted stream of batches so that every frame holds whole cells only."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) < rows:
            continue
        both = pd.concat(held, ignore_index=True)
        ids = both[[key, "_i", "_j"]].to_numpy()
        same = (ids == ids[-1]).all(axis=1)
        cut = len(both) if not same.any() else int(np.argmax(same))
        if cut:
            yield both.iloc[:cut]
        held = [both.iloc[cut:]]
    rest = pd.concat(held, ignore_index=True) if held else None
    if rest is not None and len(rest):
        yield rest


def cell_bounds(frame: pd.DataFrame, key: str) -> np.ndarray:
    """Positions at which a cell begins, and the frame's length."""
    ids = frame[[key, "_i", "_j"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
    return np.r_[starts, len(frame)]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what the edges (u, v) connect."""
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    a, b = at[: len(u)], at[len(u):]
    low = np.arange(len(nodes))
    while True:
        least = low.copy()
        np.minimum.at(least, a, low[b])
        np.minimum.at(least, b, low[a])
        least = least[least]
        if (least == low).all():
            break
        low = least
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def components(edges: DataFrame, settle_rows: Callable[[DataFrame], DataFrame] = settle) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node it reaches.

    Alternating large-star and small-star rounds: each points neighbours at the smallest
    neighbour, so the number of rounds grows with the logarithm of the longest path. Hubs are
    aggregated before the shuffle; every round is checkpointed. Loops and repeated edges are
    allowed; no edges give no rows.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    now = settle_rows(now)
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("_a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), "m")
        small = large.join(low, F.col("a") == F.col("_a")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = settle_rows(small.union(low.select("_a", "m")).distinct())
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of a set of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def pass_through(df: DataFrame, used: Sequence[str]) -> list[str]:
    """Columns of ``df`` besides ``used``."""
    return [c for c in df.columns if c not in used]
