"""Embedding near-duplicates through iterative quantisation and multi-index Hamming tables.

Iterative quantisation learns a rotation after which the signs of the coordinates are balanced,
low-error binary codes; several rotations from different starts give a code longer than the
vector. The code is cut into substrings, each the key of one table: codes that differ in fewer
bits than there are tables agree in some table. Rows of a table bucket are reranked with the
original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marketlens.llm.links import CELL, cell_bounds, cells, components, forest, whole_cells
from marketlens.session import settle

#: Rows of a cell multiplied at once.
_STEP = 1024


@dataclass(frozen=True)
class Quantiser:
    """Centre, principal directions with the learned rotations, and the cut into tables."""

    centre: np.ndarray
    planes: np.ndarray
    tables: int
    bits: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """(n, tables) substrings of the codes as numbers."""
        signs = (vectors - self.centre) @ self.planes > 0
        return signs.reshape(len(vectors), self.tables, self.bits) @ (1 << np.arange(self.bits))


def fit_quantiser(vectors: np.ndarray, tables: int, bits: int, rounds: int = 40, seed: int = 7) -> Quantiser:
    """Iterative quantisation on unit vectors: as many rotations as ``tables * bits`` needs."""
    dim = vectors.shape[1]
    centre = vectors.mean(axis=0)
    _, vecs = np.linalg.eigh(np.cov(vectors - centre, rowvar=False).reshape(dim, dim) if len(vectors) > 1 else np.eye(dim))
    projected = (vectors - centre) @ vecs
    random, planes = np.random.default_rng(seed), []
    while len(planes) * dim < tables * bits:
        rotation, _ = np.linalg.qr(random.standard_normal((dim, dim)))
        for _ in range(rounds):
            left, _, right = np.linalg.svd(projected.T @ np.where(projected @ rotation > 0, 1.0, -1.0))
            rotation = left @ right
        planes.append(vecs @ rotation)
    return Quantiser(centre, np.hstack(planes)[:, : tables * bits], tables, bits)


def usable(vector: Column) -> Column:
    """Not null, not zero, no null and no non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _stack(vectors: pd.Series, dim: int) -> np.ndarray:
    """Rows as doubles, shorter vectors filled up with zeros, then of length one."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)  # squares of tiny components must not vanish
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _encoded(model: Quantiser, dim: int):
    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            codes = model.codes(_stack(frame["vector"], dim))
            yield frame.assign(codes=list(codes.astype(np.int32)))

    return encode


def _reranked(dim: int, least: float):
    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_cells(frames, "key", 20_000):
            unit, codes = _stack(frame["vector"], dim), np.stack(frame["codes"].to_numpy())
            node, own, copies = (frame[c].to_numpy(np.int64) for c in ("node", "_own", "copies"))
            table, size = frame["tab"].to_numpy(np.int64), frame["vector"].map(len).to_numpy()
            across, total = (frame["_i"] != frame["_j"]).to_numpy(), np.zeros(len(frame), np.int64)
            bounds, u, v = cell_bounds(frame, "key"), [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                for i in range(a, b, _STEP):
                    hit = unit[i:min(b, i + _STEP)] @ unit[a:b].T >= least
                    p, q = np.nonzero(hit)
                    p, q = p + i, q + a
                    keep = (p != q) & (size[p] == size[q])
                    if across[a]:
                        keep &= own[p] != own[q]
                    p, q = p[keep], q[keep]
                    # A pair counts in the first table in which its codes agree.
                    first = ~(codes[p, : table[a]] == codes[q, : table[a]]).any(axis=1)
                    p, q = p[first], q[first]
                    if len(p):
                        np.add.at(total, p, copies[q])
                        x, y = forest(node[p], node[q])
                        u.append(x), v.append(y)
            some = np.flatnonzero(total)
            if len(some):
                x, y = forest(np.concatenate(u), np.concatenate(v))
                who, at = np.unique(node[some], return_inverse=True)
                yield pd.DataFrame({
                    "u": np.r_[who, x], "v": np.r_[np.bincount(at, total[some]).astype(np.int64), y],
                    "link": np.r_[np.zeros(len(who), bool), np.ones(len(x), bool)],
                })

    return links


def near_duplicates(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9,
    tables: int = 20, bits: int = 12, fit_rows: int = 20_000, block: int = 4096,
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    ``n_links`` counts the other vectors found with cosine >= ``least``; ``component_id`` is the
    smallest id reached over links; ``kept`` marks the row with that id. The rotations are
    fitted on at most ``fit_rows`` vectors (those with the lowest hash); every vector is
    indexed. ``bits`` should be near the logarithm of the number of vectors.

    Null, zero and non-finite vectors and vectors with null components link with nothing, nor do
    vectors of different length. Equal vectors are one node with a weight, so copies cost one
    row; repeated rows count as copies. Rows without an id never name a class. An empty table
    gives no rows; other columns are not read.
    """
    plain = rows.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector"))
    good = plain.where(usable(F.col("_vector")))
    nodes = settle(
        good.groupBy(F.col("_vector").alias("vector")).agg(F.min("_id").alias("least_id"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    dim = nodes.agg(F.max(F.size("vector"))).first()[0]
    if dim is None:
        links = rows.sparkSession.createDataFrame([], "u long, v long, link boolean")
    else:
        sample = nodes.select("vector").orderBy(F.xxhash64("vector"), "node").limit(fit_rows).toPandas()["vector"]
        model = fit_quantiser(_stack(sample, dim), tables, bits)
        coded = settle(nodes.select("node", "copies", "vector").mapInPandas(
            _encoded(model, dim), "node long, copies long, vector array<float>, codes array<int>"
        ))
        spread = coded.select("node", "copies", "vector", "codes", F.posexplode("codes").alias("tab", "part")).select(
            "node", "copies", "vector", "codes", "tab", (F.col("tab") * (1 << bits) + F.col("part")).cast("int").alias("key")
        )
        met = cells(spread, "key", F.col("node"), block).select("key", "tab", "node", "copies", "vector", "codes", *CELL)
        links = settle(met.mapInPandas(_reranked(dim, least), "u long, v long, link boolean"))
    counts = links.where("not link").groupBy(F.col("u").alias("_u")).agg(F.sum("v").alias("_links"))
    roots = components(links.where("link").select("u", "v"))
    classed = (
        nodes.join(roots, "node", "left").withColumn("_root", F.coalesce("root", "node"))
        .join(counts, F.col("node") == F.col("_u"), "left")
    )
    least_of = classed.groupBy(F.col("_root").alias("_class")).agg(F.min("least_id").alias("_component"))
    named = classed.join(least_of, F.col("_root") == F.col("_class")).select(
        "vector", "_component", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("_n")
    )
    out = plain.withColumn("_key", F.when(usable(F.col("_vector")), F.col("_vector"))).join(
        named, F.col("_key") == F.col("vector"), "left"
    )
    component = F.when(F.col("vector").isNull(), F.col("_id")).otherwise(F.col("_component"))
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"),
    )
