"""Whitening of embeddings with block matrices.

Vectors are put on a whole-number grid, so that sums over any number of rows are exact. Centred
rows get an index and go into the distributed blocks of an MLlib block matrix; the transposed
matrix times the matrix is the scatter, whose eigenvectors are taken on the driver (its size is
the square of the dimensions); the block matrix times the whitening matrix projects the rows.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketlens.llm.written import written

#: Numbers in a block; 4 MB.
BLOCK = 1 << 19
#: Blocks that one task multiplies for the scatter.
SPLIT = 8
#: Eigenvalues below this share of the largest are zero to double precision.
ZERO = 1e-13


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds neither null nor non-finite entries."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector.cast("array<double>"), fine), F.lit(False))


def on_grid(vector: Column, scale: int, offset: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(offset).cast("long"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``_index``, 0 to n - 1, to a written table with the column ``_at`` (a row id): no sort."""
    tasks = rows.groupBy(F.shiftright("_at", 33).alias("_task")).agg(F.min("_at").alias("_start"), F.count("*").alias("_len"))
    # One row per task of the step that wrote the table.
    before = F.sum("_len").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    starts = tasks.select("_task", (F.coalesce(before, F.lit(0)) - F.col("_start")).alias("_shift"))
    return rows.join(starts, F.shiftright("_at", 33) == F.col("_task")).withColumn("_index", F.col("_at") + F.col("_shift")).drop("_task", "_shift")


def block_matrix(rows: DataFrame, n: int, dims: int) -> BlockMatrix:
    """Rows (``_index``, ``_values`` array<double>) as a matrix of one column of blocks."""
    vectors = rows.select("_index", array_to_vector("_values").alias("_vector"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "_vector"), n, dims)
    return indexed.toBlockMatrix(max(1, BLOCK // dims), dims)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transposed matrix times the matrix; the rows' blocks are dealt to tasks, ``SPLIT`` to each."""
    blocks = -(-matrix.numRows() // matrix.rowsPerBlock)
    java = matrix._java_matrix_wrapper
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", java._java_model, max(1, blocks // SPLIT))
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def project(matrix: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """(_index, _z array<double>): the matrix times ``weights``."""
    spark = matrix.blocks.ctx
    rows, columns = weights.shape
    one = spark.parallelize([((0, 0), DenseMatrix(rows, columns, weights.ravel(order="F")))], 1)
    product = matrix.multiply(BlockMatrix(one, rows, columns, rows, columns)).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return found.select(F.col("index").alias("_index"), vector_to_array("vector").alias("_z"))


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    return np.maximum(values[order], 0.0), vectors[:, order]


def _identity_error(rows: DataFrame, n: int, used: list[int]) -> float | None:
    """Largest absolute entry of the covariance of ``_z`` (its ``used`` entries) minus the identity."""
    if not used:
        return None
    means = rows.agg(*[F.avg(F.col("_z")[i]) for i in used]).first()
    mean = dict(zip(used, means))
    pairs = list(combinations_with_replacement(used, 2))
    sums = rows.agg(*[F.sum((F.col("_z")[i] - mean[i]) * (F.col("_z")[j] - mean[j])) for i, j in pairs]).first()
    return max(abs(s / n - (i == j)) for (i, j), s in zip(pairs, sums))


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 8, scale: int = 1024, offset: int = 100_000,
) -> DataFrame:
    """One row per usable vector and component: id, ``component`` (from 1), ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``.

    An entry c becomes x = floor(``scale`` * c) + ``offset``; n vectors have the sums S. Components
    are unit eigenvectors of the covariance of x (divisor n), by falling eigenvalue e, at most
    ``most`` and no more than dimensions. ``deviation`` is the exact sum of (n x - S)^2 over the
    dimensions, null where that does not fit a long; ``whitened`` is x - S/n projected on the
    component over the root of e, ``explained`` e over the trace; ``identity_error`` is the largest
    absolute entry of the covariance of the whitened values minus the identity.

    Vectors that are null or hold null or non-finite entries are dropped. Shorter vectors are
    filled up with c = 0 to the longest length. Where e is zero to double precision (one row,
    equal rows, fewer rows than components), ``whitened`` is null; if all are, so are ``explained``
    and ``identity_error``. Equal eigenvalues: any of their eigenvectors, one choice for all rows.
    Repeated rows and null ids stay, each row counts. An empty table gives no rows; other columns
    are not read.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).where(usable(F.col("_v")))
    kind = plain.schema["_id"].dataType.simpleString()
    grid = written(plain.select("_id", on_grid(F.col("_v"), scale, offset).alias("_x"), F.monotonically_increasing_id().alias("_at")), "grid")
    size = grid.agg(F.count("*").alias("n"), F.max(F.size("_x")).alias("dims"), F.min(F.size("_x")).alias("least")).first()
    n, dims = size["n"], size["dims"]
    if not n or not dims:
        return spark.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if size["least"] < dims:
        grid = grid.withColumn("_x", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.get("_x", i), F.lit(offset).cast("long"))))
    per_dimension = grid.select(F.posexplode("_x")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos")
    sums = [r["s"] for r in per_dimension.collect()]  # one row per dimension

    totals = F.lit(sums).cast("array<long>")
    means = F.lit([s / n for s in sums]).cast("array<double>")
    centred = F.zip_with("_x", means, lambda x, m: x.cast("double") - m)
    rows = _numbered(grid)
    matrix = block_matrix(rows.select("_index", centred.alias("_values")), n, dims)
    covariance = scatter(matrix) / n
    values, axes = components_of(covariance, most)
    trace = float(np.trace(covariance))
    some = values > ZERO * max(values[0], 0.0)
    weights = np.where(some, axes / np.sqrt(np.where(some, values, 1.0)), 0.0)

    apart = F.zip_with("_x", totals, lambda x, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), x), s))
    square = F.aggregate(apart, F.lit(0).cast("long"), lambda a, d: F.try_add(a, F.try_multiply(d, d)))
    whole = rows.select("_id", "_index", square.alias("_deviation")).join(project(matrix, weights), "_index")
    done = written(whole.select("_id", "_deviation", "_z"), "whitened")
    error = _identity_error(done, n, [int(i) for i in np.flatnonzero(some)])

    explained = F.lit([float(v) / trace if trace > 0 else None for v in values]).cast("array<double>")
    defined = F.lit([bool(s) for s in some])
    each = done.select("_id", "_deviation", F.posexplode("_z").alias("_at", "_value"))
    return each.select(
        F.col("_id").alias(id_col), (F.col("_at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
        F.col("_deviation").alias("deviation"), F.when(F.get(defined, F.col("_at")), F.col("_value")).alias("whitened"),
        F.get(explained, F.col("_at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
