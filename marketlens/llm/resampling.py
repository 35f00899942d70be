"""Quality by importance resampling.

Texts are bags of words and word pairs hashed into buckets. Two generative models over the
buckets, one of target texts and one of all texts, give each document its log importance
weight, the log of the ratio of its probabilities. Adding Gumbel noise to the log weights and
keeping the top k draws k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marketlens.llm.written import written
from marketlens.operators.ordering import number_rows

_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Tokens of a text looked at together.
_STEP = 1 << 18


def bucket_counts(text: str | None, buckets: int) -> np.ndarray:
    """Counts of hashed words and pairs of neighbouring words."""
    counts, last = np.zeros(buckets, np.int64), None
    crc, held = zlib.crc32, []

    def add() -> None:
        nonlocal last, held
        codes = np.array(held, np.uint64)
        pairs = codes if last is None else np.r_[last, codes]
        mixed = (pairs[:-1] * np.uint64(0x9E3779B1) ^ pairs[1:]) * np.uint64(0x85EBCA6B) >> np.uint64(13)
        np.add(counts, np.bincount((np.r_[codes, mixed] % np.uint64(buckets)).astype(np.int64), minlength=buckets), out=counts)
        last, held = codes[-1:], []

    if text and len(text) <= 4 * _STEP:
        held = [crc(t.encode()) for t in _TOKEN.findall(text)]
    elif text:
        for token in _TOKEN.finditer(text):
            held.append(crc(token[0].encode()))
            if len(held) == _STEP:
                add()
    if held:
        add()
    return counts


def models(docs: DataFrame, targets: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, n_raw, n_target): n-grams of all documents and of the target's, at most ``buckets`` rows.

    ``targets`` has the target's ids as ``_target``, without repetition.
    """
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for frame in frames:
            for wanted, text in zip(frame["_good"], frame["_text"]):
                counts = bucket_counts(text, buckets)
                raw += counts
                if wanted:
                    good += counts
        some = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": some, "n_raw": raw[some], "n_target": good[some]})

    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    marked = plain.join(targets, F.col("_id") == F.col("_target"), "left").select(F.col("_target").isNotNull().alias("_good"), "_text")
    parts = marked.mapInPandas(count, "bucket int, n_raw long, n_target long")
    return parts.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))


def log_weights(raw: np.ndarray, target: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of the two smoothed bucket models."""
    share = lambda n: np.log((n + smooth) / (n.sum() + smooth * len(n)))
    return share(target.astype(float)) - share(raw.astype(float))


def gumbel(seed: int, *values: Column) -> Column:
    """Gumbel noise that depends on the seed and the values alone."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *values), 11) + 0.5) / 2.0**53
    return -F.log(-F.log(uniform))


def resample(
    docs: DataFrame, labels: DataFrame, good: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    share: float | None = None, buckets: int = 16_384, target_rows: int = 20_000, seed: int = 17,
) -> DataFrame:
    """One row per document: id, ``log_weight``, ``gumbel`` and ``kept`` (among the top k of their sum).

    The target model is fitted on the documents of at most ``target_rows`` rows of ``labels``
    with ``good`` = 1 (those with the lowest hash of their id); the raw model counts all
    documents. k is ``share`` of the documents, by default the share of good rows among all
    labelled ones. Without good labels both models are equal and the draw is uniform.

    Null and empty texts have weight zero on the log scale; repeated rows are weighed and drawn
    one by one, ties go by id. An empty table gives no rows; other columns are not read.
    """
    wanted = labels.where(F.col(good) == 1).select(id_col).where(F.col(id_col).isNotNull())
    # At most ``target_rows`` ids.
    chosen_ids = wanted.orderBy(F.xxhash64(id_col), id_col).limit(target_rows).distinct().select(F.col(id_col).alias("_target"))
    target = not chosen_ids.isEmpty()
    if share is None:
        share = labels.where(F.col(good).isNotNull()).agg(F.avg((F.col(good) == 1).cast("double"))).first()[0]
        share = 1.0 if share is None or not target else share
    raw, chosen = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in models(docs, F.broadcast(chosen_ids), buckets, id_col, text_col).collect():  # at most ``buckets`` rows
        raw[r["bucket"]], chosen[r["bucket"]] = r["n_raw"], r["n_target"]
    weights = log_weights(raw, chosen if target else raw)

    @F.pandas_udf("double")
    def log_weight(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([float(bucket_counts(t, len(weights)) @ weights) for t in texts], dtype="float64")

    # Ids stay outside Python, and the noise of a document is the same in every batch and attempt.
    noise = gumbel(seed, F.col(id_col).isNull(), F.col(id_col), F.col(text_col))
    weighed = written(docs.select(F.col(id_col).alias("_id"), log_weight(F.col(text_col)).alias("log_weight"), noise.alias("gumbel")), "weighed")
    ranked = number_rows(weighed, [(F.col("log_weight") + F.col("gumbel")).desc(), F.col("_id")])
    k = F.round(F.lit(share) * ranked.select(F.count("*").alias("n")).scalar())
    return ranked.select(F.col("_id").alias(id_col), "log_weight", "gumbel", (F.col("row_no") <= k).alias("kept"))
