"""Selections, audit rows, pools and orders of the review and product views on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.bindings.roles import ADS_SQL, RUNS_SQL, ads, job_runs, stamp, table
from marketlens.operators import filters
from marketlens.operators.ordering import number_rows
from marketlens.plans import cascade, showcase


def _judged(spark, sf):
    """Listings of which the dear ones carry a confidence."""
    return ads(spark, sf).withColumn("ai_confidence", F.when(F.col("last_price") > 100000, 0.5))


def needs_model_legacy(spark, sf):
    """Open listings for the single-model pass, beside all of them when everything is asked for."""
    rows = _judged(spark, sf)
    some = filters.needs_model_legacy(rows).select("id", F.lit("open").alias("list"))
    return some.unionByName(filters.needs_model_legacy(rows, everything=True).select("id", F.lit("all").alias("list")))


def reset_ai_state(spark, sf):
    """Every listing back to pending; what then needs the single-model pass is all of them."""
    out = cascade.reset_ai_state(_judged(spark, sf))
    return filters.needs_model_legacy(out).select("id", "ai_status", "ai_confidence", "last_price")


def run_audit(spark, sf):
    """Audit rows of the listings of even price, numbered after the job runs."""
    rows = ads(spark, sf).where(F.floor("last_price") % 2 == 0)
    results = rows.select(
        "id", F.col("urn_id").alias("input_hash"), F.col("ai_status").alias("status"), F.col("console_family").alias("taxonomy_id"),
        F.floor(F.col("last_price") / 10000).alias("confidence"), F.lit("m1").alias("selected_model"),
    )
    out = cascade.run_audit(results, job_runs(spark, sf), stamp("2024-02-01"), "p1", "t1")
    return out.select("id", "ad_id", "input_hash", "taxonomy_version", "prompt_version", "status_final", "taxonomy_id_final", "confidence_final", "selected_model")


def combo_order(spark, sf):
    """Parts as combos: their position in the order of the product view."""
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("combo_key"), F.col("p_name").alias("title"),
        F.when(F.col("p_type") == "PROMO", "Nuovo").when(F.col("p_type") == "SMALL", "Usato").otherwise(F.col("p_type")).alias("condition"),
        F.when(F.col("p_size") > 40, F.concat(F.col("p_size").cast("string"), F.lit(" TB"))).when(F.col("p_size") > 5, F.concat(F.col("p_size").cast("string"), F.lit(" GB"))).alias("storage_label"),
    )
    ordered = showcase.order_combos(rows).withColumn("_at", F.monotonically_increasing_id())
    return number_rows(ordered, [F.col("_at")], out="position").select("position", "combo_key", "title")


def offer_pool(spark, sf):
    """Small parts as favourites, all parts as catalogue, large ones as snapshot, and orders as listings: one row per address."""
    parts = table(spark, sf, "part")
    url = F.concat(F.lit("u/"), F.col("p_partkey").cast("string"))
    rows = parts.select(
        F.col("p_partkey").cast("long").alias("id"), F.col("p_brand").alias("source"), F.col("p_type").alias("condition"), F.col("p_retailprice").alias("price"),
        F.lit(1).alias("available"), F.when(F.col("p_type") != "SMALL", url).alias("url"), "p_size",
    )
    listings = ads(spark, sf).select("id", "ai_status", "last_price", "last_available", F.concat(F.lit("u/"), F.col("id").cast("string")).alias("url"))
    pooled = showcase.offer_pool(rows.where("p_size <= 10").drop("p_size"), rows.drop("p_size"), rows.where("p_size > 40").drop("p_size").withColumn("url", F.concat("url", F.lit("s"))), listings)
    return pooled.select("pool_rank", "id", "source", "condition", "price", "available", "url")


QUERIES = {
    "needs_model_legacy": (
        needs_model_legacy,
        f"WITH {ADS_SQL} SELECT id, 'open' AS list FROM ads WHERE ai_status = 'pending' AND NOT coalesce(last_price > 100000, false) UNION ALL SELECT id, 'all' FROM ads",
    ),
    "reset_ai_state": (reset_ai_state, "SELECT o_orderkey AS id, 'pending' AS ai_status, CAST(NULL AS DOUBLE) AS ai_confidence, o_totalprice AS last_price FROM orders"),
    "run_audit": (
        run_audit,
        f"WITH {ADS_SQL}, {RUNS_SQL} SELECT (SELECT max(id) FROM runs) + row_number() OVER (ORDER BY id) AS id, id AS ad_id, urn_id AS input_hash, 't1' AS taxonomy_version, 'p1' AS prompt_version, ai_status AS status_final, console_family AS taxonomy_id_final, CAST(floor(last_price / 10000) AS BIGINT) AS confidence_final, 'm1' AS selected_model FROM ads WHERE CAST(floor(last_price) AS BIGINT) % 2 = 0",
    ),
    "combo_order": (
        combo_order,
        "SELECT row_number() OVER (ORDER BY CASE p_type WHEN 'PROMO' THEN 0 WHEN 'SMALL' THEN 1 ELSE 2 END, p_name, CASE WHEN p_size > 40 THEN p_size * 1024 WHEN p_size > 5 THEN p_size ELSE 0 END DESC, CAST(p_partkey AS VARCHAR)) AS position, CAST(p_partkey AS VARCHAR) AS combo_key, p_name AS title FROM part",
    ),
    "offer_pool": (
        offer_pool,
        f"""WITH {ADS_SQL}, p AS (SELECT p_partkey AS id, p_brand AS source, p_type AS condition, p_retailprice AS price, 1 AS available, CASE WHEN p_type <> 'SMALL' THEN 'u/' || p_partkey END AS url, p_size FROM part),
pooled AS (
  SELECT 0 AS pool_rank, * EXCLUDE (p_size) FROM p WHERE p_size <= 10 UNION ALL SELECT 1, * EXCLUDE (p_size) FROM p UNION ALL SELECT 2, * EXCLUDE (p_size) REPLACE (url || 's' AS url) FROM p WHERE p_size > 40
  UNION ALL SELECT 3, id, 'subito', 'Usato', last_price, last_available, 'u/' || id FROM ads WHERE ai_status IN ('approved', 'approved_auto', 'approved_manual')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pool_rank, id) AS rn FROM pooled)
SELECT pool_rank, id, source, condition, price, available, url FROM ranked WHERE url IS NULL OR rn = 1""",
    ),
}
