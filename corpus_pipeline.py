"""Corpus pipeline: toxicity, quality rules, near-duplicates, PII, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns
of documents; the last returns packed pieces. Null and empty texts pass the toxicity stage and
are rejected by the quality rules; repeated rows count as copies; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlens.llm import packing, quality_rules, sanitise, simhash_dedup, toxicity
from marketlens.llm.queries import BYTE_BPE, table
from marketlens.session import shared_dir, tune

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose whole text scores below 0.3."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="_score").where(F.col("_score") < 0.3).select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and the learned list."""
    rules = quality_rules.learn(quality_rules.labelled(
        quality_rules.with_statistics(docs.select("doc_id", "text")), table(spark, sf_dir, "labels")
    ))
    judged = quality_rules.with_statistics(docs.withColumn("_text", F.col("text")), "_text")
    return judged.where(~quality_rules.base_failed() & quality_rules.verdict(rules)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: the one with the smallest id.

    An id names one document, so of rows with one id one stays. Documents without an id come
    after all others, in the order of a hash of their texts; a class of such documents keeps one.
    """
    # Above 2^62 there are stand-ins alone.
    stand_in = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    named = docs.select(*COLUMNS).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), stand_in))
    classes = simhash_dedup.near_duplicates(named, "_id")
    keep = classes.where(F.col("_id") == F.col("component_id")).select(F.col("_id").alias("_keep")).distinct()
    first = named.join(keep, F.col("_id") == F.col("_keep"), "left_semi")
    return first.dropDuplicates(["_id"]).select(*COLUMNS)


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and disclosing terms; ``n_chars`` follows the new text."""
    return sanitise.clean(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs, BYTE_BPE)


STAGES = [
    ("toxicity", drop_toxic), ("quality_rules", drop_low_quality), ("simhash_near_dedup", drop_near_duplicates), ("pii", remove_pii),
    ("best_fit_packing", pack),
]
#: SQL cannot express the trained stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each result is written and read again by the next."""
    tune(spark)
    folder = f"{shared_dir(spark)}/pipeline-{spark.sparkContext.applicationId}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
