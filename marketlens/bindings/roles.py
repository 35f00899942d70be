"""How the supplied tables play the engine's roles, in Spark and in SQL.

Every role covers its whole tables. The SQL text of a role is a list of common table
expressions to put after WITH.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketlens.session import tune
from marketlens.sources.tables import read_table


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    tune(spark)
    return read_table(spark, sf, name)


def stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def show_ts(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def show_day(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# --- price observations: one per order line ------------------------------------------------

FACT_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def fact(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").where((F.col("l_returnflag") != "N") | (F.col("l_linestatus") == "O"))
    parts = table(spark, sf, "part")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        *FACT_ID, F.nullif(F.col("p_type"), F.lit("SMALL")).alias("canonical_model"), F.col("p_brand").alias("console_family"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.when(F.col("l_returnflag") == "A", "cex").when(F.col("l_returnflag") == "R", "ebay").otherwise("subito").alias("source"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("available"),
        F.col("l_shipdate").alias("ts"), F.col("p_name").alias("name"), F.col("p_size").alias("size"),
    )


FACT_SQL = """
fact AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         nullif(p_type, 'SMALL') AS canonical_model, p_brand AS console_family,
         l_extendedprice / l_quantity AS price,
         CASE l_returnflag WHEN 'A' THEN 'cex' WHEN 'R' THEN 'ebay' ELSE 'subito' END AS source,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS available,
         l_shipdate AS ts, p_name AS name, p_size AS size
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_returnflag <> 'N' OR l_linestatus = 'O')"""


def offers(spark: SparkSession, sf: str) -> DataFrame:
    """Fact rows as offers of plain base models."""
    return fact(spark, sf).select(
        F.struct(*FACT_ID).alias("id"), *FACT_ID, "source", "canonical_model", "console_family", "price", "available",
        F.lit("base").alias("model_segment"), F.lit("standard").alias("edition_class"), "ts", "name", "size",
    )


def active_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Lines still open under the listing source, on the price scale of the fair values."""
    rows = fact(spark, sf).where(F.col("source") == "subito")
    none = F.lit(None).cast("string")
    return rows.select(
        *FACT_ID, "canonical_model", "console_family", F.col("price").alias("last_price"), F.col("available").alias("last_available"), "name",
        F.when(F.col("size") > 25, "http://img").otherwise("").alias("image_url"), F.when(F.col("size") > 10, "city").otherwise(none).alias("city"),
        F.lit("region").alias("region"), F.when(F.col("size") > 40, "professionale").otherwise("privato").alias("seller_type"),
        F.lit("base").alias("model_segment"), F.lit("standard").alias("edition_class"),
    )


# --- listings with a life cycle: one per order ----------------------------------------------

def ads(spark: SparkSession, sf: str) -> DataFrame:
    shipped = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("_ship"))
    orders = table(spark, sf, "orders")
    ended = F.when(F.col("_ship").isNotNull(), F.greatest("o_orderdate", "_ship"))
    sold = F.when(F.col("o_orderstatus") == "F", ended)
    rows = orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("AD-"), F.col("o_orderkey").cast("string")).alias("urn_id"), F.col("o_custkey").alias("seller"),
        F.col("o_totalprice").alias("last_price"), F.col("o_orderpriority").alias("console_family"),
        F.when(F.col("o_orderstatus") == "O", "approved").when(F.col("o_orderstatus") == "P", "pending").otherwise("approved_auto").alias("ai_status"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("last_available"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"), F.col("o_orderdate").cast("timestamp").alias("first_seen"),
        F.coalesce(ended, "o_orderdate").cast("timestamp").alias("last_seen"),
        sold.cast("timestamp").alias("sold_at"), sold.cast("timestamp").alias("sold_at_estimated"),
        F.when(sold.isNotNull(), F.datediff(sold, "o_orderdate") * 24.0).alias("sold_window_hours"),
    )


ADS_SQL = """
shipped AS (SELECT l_orderkey, max(l_shipdate) AS ship FROM lineitem GROUP BY l_orderkey),
ended AS (
  SELECT *, CASE WHEN ship IS NOT NULL THEN greatest(o_orderdate, ship) END AS ended
  FROM orders LEFT JOIN shipped ON o_orderkey = l_orderkey),
ads AS (
  SELECT o_orderkey AS id, 'AD-' || o_orderkey AS urn_id, o_custkey AS seller, o_totalprice AS last_price,
         o_orderpriority AS console_family,
         CASE o_orderstatus WHEN 'O' THEN 'approved' WHEN 'P' THEN 'pending' ELSE 'approved_auto' END AS ai_status,
         CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS last_available,
         o_orderdate AS published_at, o_orderdate AS first_seen, coalesce(ended, o_orderdate) AS last_seen,
         CASE WHEN o_orderstatus = 'F' THEN ended END AS sold_at,
         CASE WHEN o_orderstatus = 'F' THEN ended END AS sold_at_estimated,
         CASE WHEN o_orderstatus = 'F' AND ended IS NOT NULL THEN date_diff('day', o_orderdate, ended) * 24.0 END AS sold_window_hours
  FROM ended)"""


def placed_ads(spark: SparkSession, sf: str) -> DataFrame:
    """Listings with the seller's name, segment and region."""
    people = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    side = people.select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seller_type"), F.col("n_name").alias("region"))
    rows = ads(spark, sf)
    return rows.join(side, rows["seller"] == side["c_custkey"], "left").drop("c_custkey")


PLACED_SQL = ADS_SQL + """,
placed AS (
  SELECT ads.*, c_name AS name, c_mktsegment AS seller_type, n_name AS region
  FROM ads LEFT JOIN (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey) p ON seller = c_custkey)"""


# --- catalogue: one product per part ---------------------------------------------------------

def products(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with what their order lines say: seen first and last, latest price and stock."""
    seen = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"),
        F.max_by(F.struct((F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_linestatus").alias("status")), F.struct("l_shipdate", *FACT_ID)).alias("_l"),
    )
    parts = table(spark, sf, "part")
    return parts.join(seen, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("source"), F.col("p_type").alias("condition"),
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("list_price"), F.col("first_seen").cast("timestamp").alias("first_seen"),
        F.col("last_seen").cast("timestamp").alias("last_seen"), F.col("_l.price").alias("last_price"),
        F.when(F.col("_l.status") == "O", 1).when(F.col("_l.status").isNotNull(), 0).alias("last_available"),
        F.concat(F.lit("https://shop/"), F.lower(F.regexp_replace("p_name", " ", "-")), F.lit("/")).alias("url"),
    )


PRODUCTS_SQL = """
seen AS (
  SELECT l_partkey, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen,
         last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS last_price,
         last(l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS status
  FROM lineitem GROUP BY l_partkey),
products AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS source, p_type AS condition, p_size AS size, p_retailprice AS list_price,
         first_seen, last_seen, last_price, CASE WHEN status = 'O' THEN 1 WHEN status IS NOT NULL THEN 0 END AS last_available,
         'https://shop/' || lower(replace(p_name, ' ', '-')) || '/' AS url
  FROM part LEFT JOIN seen ON p_partkey = l_partkey)"""


# --- change log and job runs: one row per event ----------------------------------------------

def change_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("product_id"), F.col("ts").cast("timestamp").alias("changed_at"),
        F.col("value").alias("price_new"), F.when(F.col("event_type") != "error", 1).otherwise(0).alias("available_new"),
        F.when(F.col("event_type") == "signup", "new").when(F.col("event_type") == "purchase", "both").when(F.col("event_type") == "error", "availability").otherwise("price").alias("change_type"),
    )


LOG_SQL = """
log AS (
  SELECT event_id AS id, user_id AS product_id, ts AS changed_at, value AS price_new,
         CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS available_new,
         CASE event_type WHEN 'signup' THEN 'new' WHEN 'purchase' THEN 'both' WHEN 'error' THEN 'availability' ELSE 'price' END AS change_type
  FROM events)"""


def job_runs(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("job"), F.when(v < 60, "ok").when(v < 120, "warn").otherwise("error").alias("status"),
        F.col("ts").cast("timestamp").alias("ended_at"), F.col("props").alias("counts"), F.when(v >= 200, F.lit("value too large")).alias("error"),
    )


RUNS_SQL = """
runs AS (
  SELECT event_id AS id, event_type AS job, CASE WHEN value < 60 THEN 'ok' WHEN value < 120 THEN 'warn' ELSE 'error' END AS status,
         ts AS ended_at, props AS counts, CASE WHEN value >= 200 THEN 'value too large' END AS error
  FROM events)"""


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Document texts as log lines: the job is the document source, lines run on across documents."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("job"), F.posexplode(F.split("text", "\n")).alias("_n", "line"))
    return docs.select("job", (F.col("doc_id") * 1_000_000 + F.col("_n")).alias("line_no"), "line")


LINES_SQL = r"""
split_docs AS (SELECT doc_id, source AS job, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT job, doc_id * 1000000 + n AS line_no, parts[n + 1] AS line
  FROM split_docs, unnest(range(len(parts))) AS u(n))"""
