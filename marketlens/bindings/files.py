"""Sinks and file sources: what is written is read back and returned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketlens.bindings.catalogue import _TS, _dims, _named
from marketlens.bindings.roles import ADS_SQL, FACT_SQL, LINES_SQL, PRODUCTS_SQL, ads, fact, log_lines, products, show_ts, stamp, table
from marketlens.bindings.listings import _taxonomy, _TAX_SQL
from marketlens.functions import scores, text, titles, urls
from marketlens.operators import aggregates, joins, similarity, windows
from marketlens.plans import cascade, ingest
from marketlens.sources import logs, snapshots, tables
from marketlens.session import shared_dir


def _folder(spark):
    return f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"


def snapshot_written(spark, sf):
    """All price observations as one snapshot, written and read back."""
    folder = _folder(spark)
    rows = fact(spark, sf).select("name", "source", F.col("console_family").alias("category"), "price", (F.col("available") == 1).alias("available"), F.col("l_orderkey").cast("string").alias("sku"))
    snapshots.write_snapshot(rows, folder, "fact", "merged://fact", "2024-01-01T00:00:00")
    envelope, read = snapshots.read_written(spark, folder)
    counted = read.groupBy("source", "category").agg(F.count("*").alias("rows"), F.sum(F.col("available").cast("long")).alias("available"), F.max("price").alias("max_price"))
    return counted.withColumn("total", envelope.select("total").scalar())


def snapshot_merged(spark, sf):
    """Two snapshots of the same orders merged: the first occurrence of an item stays."""
    orders = table(spark, sf, "orders")
    first = orders.select(F.lit("a").alias("file"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("sku"), F.lit("").alias("url"), F.lit("n").alias("name"))
    second = first.withColumn("file", F.lit("b")).withColumn("sku", F.concat(F.lit("O"), F.col("pos").cast("string")))
    return snapshots.merge_snapshots(first.unionByName(second)).groupBy("file").agg(F.count("*").alias("rows"), F.sum("pos").alias("pos_sum"))


def archive_written(spark, sf):
    """Old order months archived as compressed files, and read back."""
    folder = _folder(spark)
    heads = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("file_source"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("taken"))
    _, old = snapshots.archive_older_than(heads, F.col("taken"), stamp("2001-01-01"), 1000)
    snapshots.write_archive(old, folder)
    return spark.read.json(folder).groupBy("file_source").agg(F.count("*").alias("rows"), F.sum("key").alias("keys"))


def log_files(spark, sf):
    """Document lines written as log files per source; line numbers and the last segment read back."""
    folder = _folder(spark)
    lines = log_lines(spark, sf).select(F.concat("job", F.lit(".log")).alias("name"), "line")
    lines.write.partitionBy("name").text(folder)
    read = logs.read_lines(spark, folder).withColumn("job", F.regexp_extract("file", r"name=([^/]+)\.log", 1))
    return read.groupBy("job").agg(F.count("*").alias("lines"), F.max("line_no").alias("last_line"), F.sum(F.length("line")).alias("characters"), F.count_distinct("file").alias("files")).select("job", "lines", "characters")


def metrics_files(spark, sf):
    """Daily event figures written as coverage CSV and chunk metrics JSON, and read back."""
    folder = _folder(spark)
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(
        F.round(F.avg("value"), 3).alias("coverage_pct"), F.count("*").alias("verified"), F.lit(1).cast("long").alias("skipped"), F.lit(2).cast("long").alias("sold_new")
    )
    days.write.option("header", True).csv(f"{folder}/coverage")
    table(spark, sf, "events").select(F.col("ts").cast("string").alias("ts"), F.col("user_id").alias("chunk"), F.lit(1).alias("ads_total"), F.lit(0).alias("sold"), F.lit(3).alias("blocked_403")).write.json(f"{folder}/chunks")
    coverage = logs.read_coverage(spark, f"{folder}/coverage").agg(F.lit("coverage").alias("kind"), F.count("*").alias("rows"), F.sum("verified").alias("total"))
    chunks = logs.read_chunk_metrics(spark, f"{folder}/chunks").agg(F.lit("chunks").alias("kind"), F.count("*").alias("rows"), F.sum("blocked_403").alias("total"))
    return coverage.unionByName(chunks)


def reports_written(spark, sf):
    """Reports exported under their names, and their row counts read back."""
    folder = _folder(spark)
    rows = ads(spark, sf)
    reports = {
        "db-products": joins.catalog_view(*_dims(spark, sf)), "db-base-models": joins.base_models(*_dims(spark, sf)), "db-standard-groups": aggregates.standard_groups(_named(spark, sf)),
        "subito-stats": aggregates.ad_stats(rows), "subito-sold-stats": aggregates.sold_stats(rows, ["console_family"]), "subito-ads": rows.where(F.col("last_available") == 1),
        "subito-sold": rows.where(F.col("sold_at").isNotNull()), "ebay-stats": aggregates.store_stats(fact(spark, sf).where(F.col("source") == "ebay"), "console_family", "price"),
    }
    tables.export_reports(reports, folder)
    return aggregates.table_counts({name: spark.read.json(f"{folder}/{name}") for name in reports})


def table_versions(spark, sf):
    """Two versions of a table published; the newer one is read."""
    folder = _folder(spark)
    rows = table(spark, sf, "orders")
    tables.publish(rows, folder, "orders", 1, ["o_orderstatus"])
    tables.publish(rows.withColumn("o_totalprice", F.col("o_totalprice") * 2), folder, "orders", 2, ["o_orderstatus"])
    newest = tables.latest_version(spark, folder, "orders")
    read = tables.read_version(spark, folder, "orders", newest)
    return read.groupBy("o_orderstatus").agg(F.count("*").alias("rows"), F.max("o_totalprice").alias("max_price"), F.lit(newest).alias("version"))


# --- further state changes -------------------------------------------------------------------------

def marker_source(spark, sf):
    """One brand keeps one product per address; a marker in the name makes it used."""
    rows = products(spark, sf).select(
        "id", F.replace("name", F.lit("old"), F.lit("used")).alias("name"), F.when(F.col("source") == "Brand#1", "gameshock").otherwise(F.col("source")).alias("source"), "condition", "url", "first_seen", "last_seen", "last_price", "last_available"
    )
    out, _ = ingest.normalize_marker_source(rows)
    return out.select("id", "source", "name", "condition", show_ts("first_seen").alias("first_seen"))


_MARKER = PRODUCTS_SQL + """,
named AS (SELECT *, replace(name, 'old', 'used') AS nm, CASE source WHEN 'Brand#1' THEN 'gameshock' ELSE source END AS src FROM products),
kept AS (
  SELECT first(id ORDER BY length(nm) DESC, last_seen DESC NULLS LAST, id DESC) AS id, first(nm ORDER BY length(nm) DESC, last_seen DESC NULLS LAST, id DESC) AS name, src,
         CASE WHEN regexp_matches(first(nm ORDER BY length(nm) DESC, last_seen DESC NULLS LAST, id DESC), '\\bused\\b') THEN 'Usato' ELSE 'Nuovo' END AS want, min(first_seen) AS first_seen
  FROM named WHERE src = 'gameshock' GROUP BY src, url),
shop AS (SELECT min(id) AS id, src, name, want AS condition, min(first_seen) AS first_seen FROM kept GROUP BY src, name, want),
-- Other sources are only merged where source, name and condition coincide.
rest AS (SELECT min(id) AS id, src, nm AS name, condition, min(first_seen) AS first_seen FROM named WHERE src <> 'gameshock' GROUP BY src, nm, condition)"""


def lifecycle_backfill(spark, sf):
    rows = ads(spark, sf).withColumn("name", F.col("urn_id")).withColumn("body_text", F.lit(" b ")).withColumn("classify_version", F.when(F.col("last_price") > 100000, " ")).withColumn(
        "last_active_seen", F.lit(None).cast("timestamp")
    ).withColumn("first_inactive_seen", F.lit(None).cast("timestamp")).withColumn("sold_at_estimated", F.lit(None).cast("timestamp")).withColumn("sold_window_hours", F.lit(None).cast("double"))
    steps = [(2, "second", ingest.lifecycle_backfill), (1, "first", lambda df: ingest.add_missing(df, {"text_hash": ("string", None)}))]
    out, _ = ingest.backfill(rows, steps)
    return out.select("id", "classify_version", "text_hash", "sold_window_hours", *[show_ts(c).alias(c) for c in ("last_active_seen", "first_inactive_seen", "sold_at_estimated")])


def apply_classification(spark, sf):
    """Results by the customers' nation written into their orders."""
    state = ads(spark, sf).select("id", "seller", "console_family", F.lit("s").alias("sub_model"), F.lit("base").alias("model_segment"), F.lit("standard").alias("edition_class"), F.lit("c").alias("canonical_model"), F.lit("m").alias("classify_method"), F.lit(0.1).alias("classify_confidence"))
    people = table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select("c_custkey", "c_nationkey", "c_acctbal")
    results = state.join(people, F.col("seller") == F.col("c_custkey")).select(
        "id", F.when(F.col("c_nationkey") == 3, "other").otherwise(F.col("c_nationkey").cast("string")).alias("taxonomy_id"), F.floor(F.col("c_acctbal") / 100).alias("confidence"), F.lit("approved_auto").alias("status"),
        F.lit("m1").alias("selected_model"), F.lit("console").alias("object_type"), F.lit("compatible").alias("price_signal"), F.lit("h").alias("input_hash"),
    )
    return cascade.apply_classification(state, results, _taxonomy(spark, sf), prompt="p", sold=True).drop("seller")


def _cleanable(spark, sf):
    """Products under the names of the known sources."""
    sources = {"Brand#1": "cex", "Brand#2": "gameshock", "Brand#3": "rebuy", "Brand#4": "subito", "Brand#5": "gamepeople"}
    rows = products(spark, sf).select(
        "id", F.concat(F.lit("Xbox One "), "name", F.lit(" console")).alias("name"), F.coalesce(scores.lookup(sources, F.col("source")), F.col("source")).alias("source"), "condition", "url",
        F.lit("").alias("image_url"), "first_seen", "last_seen", "last_price", "last_available", F.when(F.col("size") > 40, 1).otherwise(0).alias("is_base_model"),
    )
    log = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_orderkey").alias("id"))
    return ingest.clean_catalog(rows, log)


def clean_catalog(spark, sf):
    out, _, _ = _cleanable(spark, sf)
    return out.groupBy("source", "condition").agg(F.count("*").alias("products"), F.count_distinct("display_id").alias("numbers"))


def clean_catalog_steps(spark, sf):
    return _cleanable(spark, sf)[2]


def load_anchors(spark, sf):
    rows = products(spark, sf).select("id", "name", F.when(F.col("size") > 25, "cex").otherwise("rebuy").alias("source"), F.lit("base").alias("model_segment"), F.when(F.col("condition") == "PROMO", "special").otherwise("standard").alias("edition_class"), F.col("source").alias("console_family"), F.when(F.col("size") < 45, F.col("condition")).alias("canonical_model"))
    return similarity.load_anchors(rows)


def label_scalars(spark, sf):
    """Packaging, availability, condition and short names of products."""
    rows = table(spark, sf, "part")
    name = F.concat(F.lit("Console Xbox 360 "), "p_name", F.when(F.col("p_size") > 40, " Non Imballata").when(F.col("p_size") > 30, " scontata").otherwise(""))
    shown = F.when(F.col("p_size") > 40, "Non disponibile").when(F.col("p_size") > 30, "Disponibile").when(F.col("p_size") > 20, "prenotabile").when(F.col("p_size") > 10, "Esaurito").otherwise("")
    return rows.select(
        F.col("p_partkey").alias("id"), scores.packaging_state(F.when(F.col("p_type") == "PROMO", "rebuy").otherwise("CEX"), name, F.lit(None).cast("string")).alias("packaging"),
        scores.availability_label(shown).alias("availability"), titles.short_name(name, F.lit("360"), {"360": r"(?i)^(Microsoft\s+)?(Console\s+)?Xbox\s+(360\s*|250\s*GB\s*)"}).alias("short_name"),
        urls.condition_from_url(F.concat(F.lit("http://x/"), F.replace("p_name", F.lit("old"), F.lit("condizioni-usato")))).alias("condition"),
        text.trailing_id(F.concat(F.lit("AD-"), (F.col("p_partkey") + 99000).cast("string"))).alias("public_id"), scores.quality_band(F.col("p_size") * 2.0).alias("quality"),
    )


def repoint(spark, sf):
    """Order lines of merged parts go to the surviving part."""
    rows = products(spark, sf).select("id", "name", "source", "condition", "url", "first_seen", "last_seen", "last_price", "last_available")
    _, moved = windows.dedupe_by_url(rows, ["Brand#1", "Brand#2"])
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("product_id"), "l_quantity")
    return windows.repoint(lines, moved, "product_id").groupBy("product_id").agg(F.count("*").alias("rows"), F.sum("l_quantity").alias("quantity"))


QUERIES = {
    "snapshot_written": (
        snapshot_written,
        f"WITH {FACT_SQL} SELECT source, console_family AS category, count(*) AS rows, count(*) FILTER (available = 1) AS available, max(price) AS max_price, (SELECT count(*) FROM fact) AS total FROM fact GROUP BY 1, 2",
    ),
    "snapshot_merged": (
        snapshot_merged,
        "SELECT 'a' AS file, count(*) AS rows, CAST(sum(k) AS BIGINT) AS pos_sum FROM (SELECT min(o_orderkey) AS k FROM orders GROUP BY o_custkey) x UNION ALL SELECT 'b', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders",
    ),
    "archive_written": (
        archive_written,
        "SELECT o_orderpriority AS file_source, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' - INTERVAL 1000 DAY GROUP BY 1",
    ),
    "log_files": (log_files, f"WITH {LINES_SQL} SELECT job, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS characters FROM lines GROUP BY 1"),
    "metrics_files": (
        metrics_files,
        "SELECT 'coverage' AS kind, count(DISTINCT CAST(ts AS DATE)) AS rows, count(*) AS total FROM events UNION ALL SELECT 'chunks', count(*), 3 * count(*) FROM events",
    ),
    "reports_written": (
        reports_written,
        f"WITH {ADS_SQL}, {PRODUCTS_SQL}, n AS (SELECT CASE WHEN size > 30 THEN name || '|' || condition ELSE 'name:' || lower(name) END AS k FROM products) SELECT 'db-products' AS \"table\", (SELECT count(*) FROM part) AS rows UNION ALL SELECT 'db-base-models', (SELECT count(*) FROM part WHERE p_retailprice < 950) UNION ALL SELECT 'db-standard-groups', (SELECT count(DISTINCT k) FROM n) UNION ALL SELECT 'subito-stats', 1 UNION ALL SELECT 'subito-sold-stats', (SELECT count(DISTINCT console_family) FROM ads WHERE sold_at IS NOT NULL) UNION ALL SELECT 'subito-ads', (SELECT count(*) FROM ads WHERE last_available = 1) UNION ALL SELECT 'subito-sold', (SELECT count(*) FROM ads WHERE sold_at IS NOT NULL) UNION ALL SELECT 'ebay-stats', (SELECT count(DISTINCT p_brand) + 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R')",
    ),
    "table_versions": (table_versions, "SELECT o_orderstatus, count(*) AS rows, max(o_totalprice * 2) AS max_price, 2 AS version FROM orders GROUP BY 1"),
    "normalize_marker_source": (
        marker_source,
        f"WITH {_MARKER} SELECT id, src AS source, name, condition, strftime(first_seen, '{_TS}') AS first_seen FROM shop UNION ALL SELECT id, src, name, condition, strftime(first_seen, '{_TS}') FROM rest",
    ),
    "lifecycle_backfill": (
        lifecycle_backfill,
        f"WITH {ADS_SQL} SELECT id, 'legacy' AS classify_version, sha1(lower(urn_id) || chr(10) || 'b') AS text_hash, CASE WHEN sold_at IS NOT NULL THEN 0.0::DOUBLE END AS sold_window_hours, strftime(CASE WHEN last_available = 1 AND sold_at IS NULL THEN last_seen END, '{_TS}') AS last_active_seen, strftime(sold_at, '{_TS}') AS first_inactive_seen, strftime(sold_at, '{_TS}') AS sold_at_estimated FROM ads",
    ),
    "apply_classification": (
        apply_classification,
        f"WITH {_TAX_SQL}, j AS (SELECT o.o_orderkey AS id, o_orderpriority, c_custkey IS NOT NULL AS hit, CASE WHEN c_nationkey = 3 THEN 'other' ELSE CAST(c_nationkey AS VARCHAR) END AS want, c_acctbal FROM orders o LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0) SELECT id, CASE WHEN hit THEN coalesce(family_key, 'other') ELSE o_orderpriority END AS console_family, CASE WHEN NOT hit THEN 's' WHEN tid IS NULL THEN 'Unknown' ELSE 'Base' END AS sub_model, CASE WHEN NOT hit THEN 'base' WHEN tid IS NULL THEN 'unknown' WHEN type = 'Speciale' THEN 'premium' ELSE 'base' END AS model_segment, CASE WHEN hit AND type = 'Speciale' THEN 'special' ELSE 'standard' END AS edition_class, CASE WHEN NOT hit THEN 'c' ELSE coalesce(tid, 'other') END AS canonical_model, CASE WHEN hit THEN 'ai-cascade:m1:approved_auto' ELSE 'm' END AS classify_method, CASE WHEN hit THEN floor(c_acctbal / 100) / 100 ELSE 0.1 END AS classify_confidence FROM j LEFT JOIN tax ON hit AND tid = want",
    ),
    "clean_catalog": (clean_catalog, None),
    "clean_catalog_steps": (clean_catalog_steps, None),
    "load_anchors": (load_anchors, "SELECT p_partkey AS id, p_name AS name, p_brand AS console_family, p_type AS canonical_model FROM part WHERE p_size > 25 AND p_type <> 'PROMO' AND p_size < 45"),
    "label_scalars": (
        label_scalars,
        "SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN 'Imballata' WHEN p_size > 40 THEN 'Non Imballata' WHEN p_size > 30 THEN 'Scontata' ELSE 'Imballata' END AS packaging, CASE WHEN p_size > 40 THEN 'Non disponibile' WHEN p_size > 30 THEN 'Disponibile' WHEN p_size > 20 THEN 'Ordinabile' WHEN p_size > 10 THEN 'Esaurito' ELSE 'N/D' END AS availability, p_name || CASE WHEN p_size > 40 THEN ' Non Imballata' WHEN p_size > 30 THEN ' scontata' ELSE '' END AS short_name, CASE WHEN p_name LIKE '%old%' THEN 'Usato' ELSE 'Nuovo' END AS condition, CAST(p_partkey + 99000 AS VARCHAR) AS public_id, CASE WHEN p_size * 2 >= 75 THEN 'high' WHEN p_size * 2 >= 55 THEN 'medium' ELSE 'low' END AS quality FROM part",
    ),
    "repoint": (
        repoint,
        f"WITH {PRODUCTS_SQL}, k AS (SELECT id, CASE WHEN source IN ('Brand#1', 'Brand#2') THEN first_value(id) OVER (PARTITION BY source, url ORDER BY length(name) DESC, last_seen DESC NULLS LAST, id DESC) ELSE id END AS keep FROM products) SELECT keep AS product_id, count(*) AS rows, sum(l_quantity) AS quantity FROM lineitem JOIN k ON l_partkey = id GROUP BY 1",
    ),
}
