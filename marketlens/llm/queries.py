"""Registered queries of the operators, with SQL where SQL can say the same."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketlens.llm import alignment, embedding_dedup, line_dedup, packing, quality_rules, resampling, sanitise, sentencepiece_codec, simhash_dedup, token_counts, toxicity, warc, whitening
from marketlens.session import tune

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), PIECES)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), held_out())
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), BYTE_BPE)


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged, _ = quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def _digests(ids: list[int], text: str) -> tuple[int, str, str]:
    joined = " ".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, folder, "documents"), PIECES, _digests)


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.archive_folder(spark)
    files = warc.write_archives(table(spark, folder, "pages"), archives)
    return warc.read_records(files, archives).withColumnRenamed("page", "page_id")


OP6_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest AS payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 1000
"""


def op7_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = sanitise.find(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    terms = F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(
        "doc_id", *[count(k) for k in sanitise.KINDS], F.sha2(sanitise.span_text(base).cast("binary"), 256).alias("base_sha256"),
        sanitise.span_text(F.concat(base, terms)).alias("spans"),
    )


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, folder, "documents"))


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = """
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), k AS (
    SELECT doc_id, line, pos, translate(
        trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'
    ) AS key FROM l
), f AS (
    SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
    SELECT k.doc_id, line, pos, f.key IS NOT NULL AND k.doc_id <> f.last_id AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op12_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), BYTE_BPE, PIECES)


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_toxicity": (op2_toxicity, None),
    "op3_best_fit_packing": (op3_best_fit_packing, None),
    "op4_quality_rules": (op4_quality_rules, None),
    "op5_sentencepiece": (op5_sentencepiece, None),
    "op6_warc": (op6_warc, OP6_SQL),
    "op7_embedding_near_dedup": (op7_embedding_near_dedup, None),
    "op8_pii": (op8_pii, None),
    "op9_quality_classifier": (op9_quality_classifier, None),
    "op10_simhash_near_dedup": (op10_simhash_near_dedup, None),
    "op11_line_dedup": (op11_line_dedup, OP11_SQL),
    "op12_cross_tokenizer_alignment": (op12_cross_tokenizer_alignment, None),
    "op13_embedding_whitening": (op13_embedding_whitening, None),
}
