"""Listings: life cycle, dashboards, views, verification, review, scoring."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marketlens import catalog
from marketlens.bindings.roles import ADS_SQL, PLACED_SQL, ads, placed_ads, show_day, show_ts, stamp, table
from marketlens.functions import text, times
from marketlens.functions.text import trailing_id
from marketlens.operators import aggregates, filters, joins, windows
from marketlens.plans import cascade, verify
from marketlens.plans.ingest import set_values

_TS = "%Y-%m-%d %H:%M:%S"


def ad_stats(spark, sf):
    return aggregates.ad_stats(ads(spark, sf))


def sold_stats(spark, sf):
    return aggregates.sold_stats(ads(spark, sf))


def sold_by_family(spark, sf):
    return aggregates.sold_stats(ads(spark, sf), ["console_family"])


_SOLD = """count(*) AS total_sold, avg(last_price) FILTER (last_price > 0) AS avg_price, min(last_price) FILTER (last_price > 0) AS min_price,
max(last_price) FILTER (last_price > 0) AS max_price, avg((epoch_us(coalesce(sold_at_estimated, sold_at)) - epoch_us(coalesce(published_at, first_seen))) / 3600000000.0::DOUBLE) AS avg_hours_active,
avg(sold_window_hours) AS avg_sold_window_hours FROM ads WHERE sold_at IS NOT NULL"""


def sold_by(what):
    return lambda spark, sf: aggregates.sold_by(ads(spark, sf), what)


def _event_sales(spark, sf):
    """Sales with a time of day: error events as ended listings."""
    rows = table(spark, sf, "events")
    ended = F.when(F.col("event_type") == "error", F.col("ts"))
    return rows.select(F.col("event_id").alias("id"), ended.alias("sold_at"), ended.alias("sold_at_estimated"))


def sold_by_clock(what):
    return lambda spark, sf: aggregates.sold_by(_event_sales(spark, sf), what)


def _sold_days(spark, sf):
    rows = ads(spark, sf).where(F.col("sold_at").isNotNull())
    return rows.withColumn("day", times.sold_day(F.col("sold_at_estimated"), F.col("sold_at"), F.col("last_seen")))


_SOLD_DAYS = ADS_SQL + ", sold AS (SELECT *, CAST(coalesce(sold_at_estimated, sold_at, last_seen) AS DATE) AS day FROM ads WHERE sold_at IS NOT NULL)"


def sold_range(spark, sf):
    kept = filters.sold_range(_sold_days(spark, sf), "day", 365)
    return kept.select("id", show_day("day").alias("day"))


def daily_series(spark, sf):
    return aggregates.daily_sold(_sold_days(spark, sf), "day", "last_price").withColumn("day", show_day("day"))


def sold_dashboard(spark, sf):
    out = aggregates.sold_dashboard(_sold_days(spark, sf), "day", "last_price")
    return out.select("total", "days", "peak_count", "avg_per_day", *[show_day(c).alias(c) for c in ("peak_day", "first_day", "last_day")])


def family_sold_series(spark, sf):
    return aggregates.family_sold_series(_sold_days(spark, sf), "day", "last_price")


def listing_view(mode):
    return lambda spark, sf: filters.listing_view(ads(spark, sf), mode).select("id", "ai_status", "last_price")


def market_parts(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return filters.exclude_parts(rows, "name", "anvil|rott[ao]|old gear")


def listing_filter(spark, sf):
    public = trailing_id(F.concat(F.col("urn_id"), F.lit("00000")))
    rows = filters.listing_filter(placed_ads(spark, sf), text="0001", family="1-URGENT", region="NATION_7", public_id=public)
    return rows.select("id", "name", "region", "last_price")


def market_kpis(spark, sf):
    rows = filters.listing_view(placed_ads(spark, sf), "approved")
    return aggregates.market_kpis(rows, F.concat_ws("/", "console_family", "seller_type"), "last_price")


def regions(spark, sf):
    return aggregates.distinct_values(placed_ads(spark, sf), "region")


def market_order(spark, sf):
    rows = filters.listing_view(ads(spark, sf), "approved")
    return windows.market_order(rows, "console_family", "approved").select("id", "console_family", "last_price", "position")


def market_order_sold(spark, sf):
    rows = filters.listing_view(ads(spark, sf), "sold")
    return windows.market_order(rows, "console_family", "sold").select("id", "console_family", "position")


def all_ads(spark, sf):
    rows = windows.all_ads(placed_ads(spark, sf))
    return rows.select("id", "urn_id", "name", "console_family", "region", "seller_type", "last_price", "last_available", "ai_status")


def sold_listings(spark, sf):
    return windows.sold_listings(ads(spark, sf)).select("id", "console_family", show_ts("sold_at").alias("sold_at"), "last_price")


def newest_sold(spark, sf):
    rows = ads(spark, sf).where(F.col("sold_at").isNotNull())
    return windows.newest_sold(rows, 200).select("id", show_ts("first_seen").alias("first_seen"), "last_price")


def active_ads(spark, sf):
    return filters.active_ads(ads(spark, sf), stamp("2001-08-01"), 400).select("id", "console_family", "last_price")


def duration(spark, sf):
    rows = ads(spark, sf).where(F.col("sold_at").isNotNull())
    hours = times.hours_between(F.col("sold_at"), F.col("published_at"))
    return rows.select("id", times.duration_text(hours).alias("on_sale"))


# --- verification ---------------------------------------------------------------------------

_AS_OF = "2001-08-02"
_STATUSES = ("approved", "pending", "approved_auto")


def _verifiable(spark, sf):
    """Listings with text, last check and verify status; customers' balance sets the status."""
    people = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("body_text"), "c_acctbal")
    rows = ads(spark, sf).join(people, F.col("seller") == F.col("c_custkey"), "left").drop("c_custkey")
    return (
        rows.withColumn("url", F.concat(F.lit("https://site/"), F.col("urn_id")))
        .withColumn("verify_status", F.when(F.col("c_acctbal") < 0, "pending").otherwise("buyable"))
        .withColumn("last_verified_at", F.when(F.col("c_acctbal") < 8000, F.col("last_seen")))
        .withColumn("last_active_seen", F.when(F.col("last_available") == 1, F.col("last_seen")))
        .withColumn("first_inactive_seen", F.col("sold_at"))
    )


_VERIFIABLE = ADS_SQL + """,
verifiable AS (
  SELECT ads.*, c_name AS name, c_mktsegment AS body_text, 'https://site/' || urn_id AS url,
         CASE WHEN c_acctbal < 0 THEN 'pending' ELSE 'buyable' END AS verify_status,
         CASE WHEN c_acctbal < 8000 THEN last_seen END AS last_verified_at,
         CASE WHEN last_available = 1 THEN last_seen END AS last_active_seen, sold_at AS first_inactive_seen
  FROM ads LEFT JOIN customer ON seller = c_custkey)"""


def _topic():
    """The topic filter with words of the supplied texts."""
    return filters.topic_match(
        F.col("name"), F.col("body_text"), F.col("url"), any_of=("machinery",), model=("build", "house"), context=("customer",)
    )


_TOPIC = (
    "(lower(name) LIKE '%machinery%' OR lower(body_text) LIKE '%machinery%' OR lower(url) LIKE '%machinery%' OR "
    "((lower(name) LIKE '%build%' OR lower(name) LIKE '%house%' OR lower(body_text) LIKE '%build%' OR lower(body_text) LIKE '%house%') "
    "AND (lower(name) LIKE '%customer%' OR lower(body_text) LIKE '%customer%')))"
)


def topic_match(spark, sf):
    return _verifiable(spark, sf).select("id", _topic().alias("on_topic"))


def selection_funnel(spark, sf):
    return aggregates.selection_funnel(_verifiable(spark, sf), _STATUSES, _topic())


def selection_priority(spark, sf):
    rows = verify.select_for_verification(_verifiable(spark, sf), stamp(_AS_OF), statuses=_STATUSES, tiered=False, on_topic=_topic())
    return rows.select("id", "verify_status", show_ts("last_seen").alias("last_seen"))


def selection_stale(spark, sf):
    """The tier that is not sampled, and recent sales."""
    rows = verify.select_for_verification(
        _verifiable(spark, sf), stamp(_AS_OF), statuses=_STATUSES, staleness_hours=24 * 90, sample_ratio=0.0, recheck_days=120, on_topic=_topic()
    )
    return rows.select("id", "tier")


def selection_sample(spark, sf):
    """Size of the sampled tier next to what it was taken from."""
    rows = _verifiable(spark, sf)
    chosen = verify.select_for_verification(rows, stamp(_AS_OF), statuses=_STATUSES, staleness_hours=24 * 90, on_topic=_topic())
    return chosen.groupBy("tier").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("distinct_rows"))


def excluded_sample(spark, sf):
    rows = verify.excluded_sample(_verifiable(spark, sf), _STATUSES, _topic(), 50)
    return rows.select("id", "name")


def random_probe(spark, sf):
    return windows.random_probe(filters.unsold_active(ads(spark, sf), _STATUSES), 10, seed=7).select("id", "urn_id")


def _fetches(spark, sf):
    """A fetch log: one per order, its line figures standing in for the answers."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.max("l_quantity").alias("q"), F.min("l_discount").alias("d"), F.max("l_tax").alias("t")
    )
    rows = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    q, d, t = F.coalesce("q", F.lit(0.0)), F.coalesce("d", F.lit(0.0)), F.coalesce("t", F.lit(0.0))
    home = F.lit(catalog.SOLD_HOME + "/")
    return rows.select(
        F.col("o_orderkey").alias("id"), F.concat_ws("/", "o_orderpriority", F.year("o_orderdate").cast("string")).alias("chunk"),
        F.when(q >= 49, 410).when(q >= 30, 200).otherwise(403).alias("pre_status"),
        F.when((q >= 30) & (d <= 0.01), home).otherwise(F.lit("https://site/x")).alias("pre_url"),
        F.when(t >= 0.08, F.lit(None).cast("int")).when(q < 5, 404).when(q < 10, 403).when(q < 12, 503).otherwise(200).alias("page_status"),
        F.when(d >= 0.09, F.lit("https://site/annunci-italia/vendita/?q=x")).otherwise(F.lit("https://site/x")).alias("page_url"),
        F.when(q < 20, F.lit("Questo annuncio non è più disponibile")).otherwise(F.lit("in vendita")).alias("page_body"),
        F.when((t >= 0.07) & (t < 0.08), F.lit("page.goto: Timeout 9000ms exceeded")).alias("page_error"), F.lit(True).alias("page_tried"),
    )


_OUTCOMES = """
f0 AS (
  SELECT o_orderkey AS id, o_orderpriority || '/' || year(o_orderdate) AS chunk, coalesce(q, 0) AS q, coalesce(d, 0) AS d, coalesce(t, 0) AS t
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS q, min(l_discount) AS d, max(l_tax) AS t FROM lineitem GROUP BY 1) x ON o_orderkey = l_orderkey),
f1 AS (SELECT *, CASE WHEN q >= 49 THEN 'sold' WHEN q >= 30 THEN CASE WHEN d <= 0.01 THEN 'sold' ELSE 'active' END ELSE 'unknown' END AS pre FROM f0),
f2 AS (SELECT *, avg((pre = 'unknown')::INT) OVER (PARTITION BY chunk) AS share FROM f1),
f3 AS (
  SELECT *, CASE WHEN pre = 'sold' THEN 'sold:precheck' WHEN share >= {block} THEN 'skipped:cffi-block' WHEN pre = 'active' THEN 'active:cffi-200'
    WHEN share >= {partial} THEN 'skipped:cffi-partial' WHEN t >= 0.07 AND t < 0.08 THEN 'blocked:timeout' WHEN t >= 0.08 THEN 'blocked:no-response'
    WHEN d >= 0.09 THEN 'sold:redirect' WHEN q < 5 THEN 'sold:http-status' WHEN q < 10 THEN 'blocked:http-403' WHEN q < 12 THEN 'blocked:http-503'
    WHEN q < 20 THEN 'sold:dom-marker' ELSE 'active:dom-ok' END AS reason
  FROM f2),
outcomes AS (
  SELECT id, chunk, reason, CASE WHEN reason LIKE 'sold:%' THEN 'sold' WHEN reason LIKE 'active:%' THEN 'active' ELSE 'pending' END AS outcome FROM f3)"""
_RATIOS = {"block": 0.24, "partial": 0.2}


def _outcomes(spark, sf):
    return verify.classify_outcomes(_fetches(spark, sf), _RATIOS["block"], _RATIOS["partial"])


def outcomes(spark, sf):
    return _outcomes(spark, sf).select("id", "chunk", "reason", "outcome")


def reason_counts(spark, sf):
    return aggregates.reason_counts(_outcomes(spark, sf))


def top_reasons(spark, sf):
    return aggregates.top_reasons(aggregates.reason_counts(_outcomes(spark, sf)), 4)


def unstable_hits(spark, sf):
    return aggregates.unstable_hits(aggregates.reason_counts(_outcomes(spark, sf)))


_LIFE = ("last_seen", "last_active_seen", "first_inactive_seen", "sold_at", "sold_at_estimated", "last_verified_at")


def _verified(spark, sf):
    return verify.apply_verification(_verifiable(spark, sf), _outcomes(spark, sf), stamp(_AS_OF))


def apply_verification(spark, sf):
    state, _, _ = _verified(spark, sf)
    return state.select("id", "last_available", "verify_status", "sold_window_hours", *[show_ts(c).alias(c) for c in _LIFE])


def verification_changes(spark, sf):
    _, log, _ = _verified(spark, sf)
    return log.select("ad_id", "price_old", "price_new", "available_old", "available_new", "change_type")


def verification_summary(spark, sf):
    _, _, detail = _verified(spark, sf)
    return aggregates.verification_summary(detail)


def verification_chunks(spark, sf):
    _, _, detail = _verified(spark, sf)
    return aggregates.verification_summary(detail, ["chunk"]).select("chunk", "attempted", "verified", "sold", "blocked_403", "coverage_ratio")


_NOW = f"TIMESTAMP '{_AS_OF}'"
_VERIFIED = _VERIFIABLE + "," + _OUTCOMES.format(**_RATIOS) + f""",
v0 AS (
  SELECT a.*, outcome, reason, chunk, coalesce(first_inactive_seen, {_NOW}) AS fi, coalesce(last_active_seen, last_seen) AS la
  FROM verifiable a LEFT JOIN outcomes o USING (id)),
v1 AS (
  SELECT *, CASE WHEN fi >= la THEN make_timestamp(epoch_us(la) + (epoch_us(fi) - epoch_us(la)) // 2) ELSE fi END AS mid,
         CASE WHEN fi >= la THEN (epoch_us(fi) - epoch_us(la)) / 3600000000.0::DOUBLE END AS win
  FROM v0),
v2 AS (SELECT *, coalesce(sold_at_estimated, mid, sold_at, {_NOW}) AS est FROM v1)"""


def _step(column, active, sold):
    return f"CASE outcome WHEN 'active' THEN {active} WHEN 'sold' THEN {sold} ELSE {column} END"


_APPLY = _VERIFIED + f"""
SELECT id, {_step('last_available', '1', '0')} AS last_available,
       CASE outcome WHEN 'active' THEN 'buyable' WHEN 'sold' THEN 'sold' WHEN 'pending' THEN 'pending' ELSE verify_status END AS verify_status,
       {_step('sold_window_hours', 'NULL', 'CASE WHEN sold_at_estimated IS NOT NULL THEN sold_window_hours ELSE win END')} AS sold_window_hours,
       strftime({_step('last_seen', _NOW, _NOW)}, '{_TS}') AS last_seen, strftime({_step('last_active_seen', _NOW, 'last_active_seen')}, '{_TS}') AS last_active_seen,
       strftime({_step('first_inactive_seen', 'NULL', 'fi')}, '{_TS}') AS first_inactive_seen, strftime({_step('sold_at', 'NULL', f'coalesce(sold_at, {_NOW})')}, '{_TS}') AS sold_at,
       strftime({_step('sold_at_estimated', 'NULL', 'est')}, '{_TS}') AS sold_at_estimated, strftime({_step('last_verified_at', _NOW, _NOW)}, '{_TS}') AS last_verified_at
FROM v2"""
_SUMMARY_COLS = """count(*) AS attempted, count(*) FILTER (outcome IN ('active', 'sold')) AS verified, count(*) FILTER (outcome = 'active') AS active,
  count(*) FILTER (outcome = 'sold' AND last_available = 1) AS sold, count(*) FILTER (outcome = 'sold' AND last_available = 0) AS already_sold,
  count(*) FILTER (outcome = 'active' AND last_available = 0) AS recovered, count(*) FILTER (outcome = 'pending') AS skipped,
  count(*) FILTER (reason LIKE '%http-403%') AS blocked_403, count(*) FILTER (reason = 'skipped:cffi-block') AS blocked_precheck,
  count(*) FILTER (reason LIKE 'blocked:%' OR reason = 'skipped:cffi-block') AS blocked_total,
  avg(last_price) FILTER (outcome = 'sold' AND last_available = 1 AND last_price > 0) AS avg_price_sold,
  avg((epoch_us(est) - epoch_us(first_seen)) / 3600000000.0::DOUBLE) FILTER (outcome = 'sold' AND last_available = 1 AND est >= first_seen) AS avg_hours_active"""


# --- model scoring and review ----------------------------------------------------------------

def _taxonomy(spark, sf):
    """Nations as catalogue rows, their region as the family."""
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        F.col("n_nationkey").alias("rank"), F.col("n_nationkey").cast("string").alias("id"), F.lit("N").alias("product"),
        F.when(F.col("n_nationkey") > 12, "Speciale").otherwise("Canonico").alias("type"), F.col("r_name").alias("family"), F.lit("base").alias("model"),
        F.lit("").alias("memory"), F.lit("").alias("shell"), F.col("n_name").alias("label"), F.lower("r_name").alias("family_key"),
    )


_TAX_SQL = """
tax AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS tid, CASE WHEN n_nationkey > 12 THEN 'Speciale' ELSE 'Canonico' END AS type, r_name AS family, n_name AS label, lower(r_name) AS family_key
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def taxonomy_join(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_nationkey").cast("string")).alias("ai_id"), F.lit("3").alias("canonical"))
    out = joins.with_taxonomy(rows, _taxonomy(spark, sf), ["ai_id", "canonical"])
    return out.select("id", "tax_id", "tax_type", "tax_family", "tax_label")


def fields_of(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "other").otherwise(F.col("c_nationkey").cast("string")).alias("tid"))
    return joins.fields_of(rows, _taxonomy(spark, sf), "tid").drop("tid")


def taxonomy_ids(spark, sf):
    """Customers whose nation id is a legal catalogue id, counted per id."""
    ids = _taxonomy(spark, sf).select(F.col("id").alias("tid"))
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("tid"))
    return rows.join(ids, "tid", "left_semi").groupBy("tid").agg(F.count("*").alias("rows"))


def _runs(spark, sf):
    """Classification runs: one per order line of the order, its figures standing in for the result."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100).alias("_base"), F.col("l_orderkey").alias("ad_id"), F.col("l_partkey"), F.col("l_extendedprice"),
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("selected_model"), F.col("l_shipdate").alias("created_at"), F.col("l_suppkey"),
    ).select(
        F.struct("_base", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), "ad_id", "selected_model", "created_at"
    )


def pending_reviews(spark, sf):
    rows = ads(spark, sf).withColumn("ai_status", F.when(F.col("ai_status") == "pending", "pending_review").otherwise(F.col("ai_status")))
    people = table(spark, sf, "customer").select("c_custkey", (F.round(F.col("c_acctbal") / 100) + 0.0).alias("ai_confidence"))
    joined = rows.join(people, F.col("seller") == F.col("c_custkey"), "left").drop("c_custkey")
    out = joins.pending_reviews(joined, _runs(spark, sf))
    return out.select("id", "ai_confidence", "selected_model", show_ts("classified_at").alias("classified_at"))


def latest_run_per_ad(spark, sf):
    newest = joins.latest_per_key(_runs(spark, sf), ["ad_id"], ["id"])
    return newest.select("ad_id", "selected_model", show_ts("created_at").alias("created_at"))


_RUN_ORDER = "l_orderkey * 1000 + l_linenumber * 100, l_partkey, l_suppkey, l_extendedprice"
_LATEST = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey * 1000 + l_linenumber * 100 DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem),
newest AS (SELECT l_orderkey AS ad_id, 'm' || l_linenumber AS selected_model, strftime(l_shipdate, '{_TS}') AS created_at FROM ranked WHERE rn = 1)"""


def _reviewed(spark, sf):
    """Documents as listings, labels as the decisions: quality approves, toxic makes it ``other``."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("ai_taxonomy_id"), F.lit("pending_review").alias("ai_status"), F.col("lang").alias("console_family"),
        F.lit("base").alias("sub_model"), F.lit("base").alias("model_segment"), F.lit("standard").alias("edition_class"), F.lit("unknown").alias("canonical_model"),
        F.lit("rules").alias("classify_method"), F.lit(0.5).alias("classify_confidence"),
    )
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("ad_id"),
        # A label without quality or toxicity asks for an id that does not exist.
        F.when(F.col("toxic") == 1, "other").when(F.col("quality") == 1, (F.col("doc_id") % 25).cast("string")).otherwise("none").alias("human_taxonomy_id"),
        F.lit(None).cast("string").alias("human_status"), F.lit("label").alias("review_reason"), F.lit(None).cast("long").alias("run_id"),
    )
    runs = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("ad_id"))
    return cascade.apply_review(docs, labels, runs, _taxonomy(spark, sf), stamp("2024-01-01"))


def apply_review(spark, sf):
    state, _, _ = _reviewed(spark, sf)
    return state


def review_audit(spark, sf):
    _, audit, _ = _reviewed(spark, sf)
    return audit.drop("reviewed_at")


def review_errors(spark, sf):
    _, _, errors = _reviewed(spark, sf)
    return errors


_REVIEW = _TAX_SQL + """,
decided AS (
  SELECT doc_id AS ad_id, CASE WHEN toxic = 1 THEN 'other' WHEN quality = 1 THEN CAST(doc_id % 25 AS VARCHAR) ELSE 'none' END AS human FROM labels),
good AS (SELECT ad_id, human, CASE WHEN human = 'other' THEN 'rejected_manual' ELSE 'approved_manual' END AS status FROM decided WHERE human <> 'none'),
last_runs AS (SELECT conv_id AS ad_id, max(conv_id * 1000 + turn) AS run_id FROM conversations GROUP BY 1)"""


def _content_hash() -> Column:
    return text.input_hash(F.col("o_orderpriority"), F.col("c_nationkey").cast("string"), F.lit(None).cast("double"), "p1", "t1")


def _scored_rows(spark, sf):
    """Listings to score with the hash of what is scored; earlier runs cover urgent orders."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("price"), _content_hash().alias("input_hash"),
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), "o_orderpriority",
    )


def _scorer(shift):
    def score(rows):
        return rows.withColumn("taxonomy_id", F.when(F.col("balance") > 9000, "nowhere").otherwise(F.col("nation").cast("string"))).withColumn(
            "confidence", F.floor(F.col("balance") / 100 + shift).cast("string")
        ).withColumn("object_type", F.when(F.col("nation") == 5, "accessory").when(F.col("nation") == 6, "thing").otherwise("console")).withColumn(
            "price_signal", F.when(F.col("nation") == 8, "suspicious_low").otherwise("compatible")
        ).withColumn("decision_reason", F.concat(F.lit("  balance "), F.lit(str(shift)), F.lit("  ")))

    return score


def _bounds(df, _taxonomy):
    """Price bounds of the rows that have an id of the catalogue."""
    known = F.col("taxonomy_id") != "other"
    return df.withColumn("price_low", F.when(known, F.lit(20.0))).withColumn("price_high", F.when(known, F.lit(400.0)))


def _cascaded(spark, sf):
    rows = _scored_rows(spark, sf)
    runs = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("id"), _content_hash().alias("input_hash"),
        F.col("c_nationkey").cast("string").alias("taxonomy_id_final"), F.lit(91).cast("long").alias("confidence_final"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "pending_review").otherwise("approved_auto").alias("status_final"), F.col("o_orderstatus").alias("selected_model"),
    )
    return cascade.cascade(rows, [("m1", _scorer(0)), ("m2", _scorer(20)), ("m3", _scorer(30))], _taxonomy(spark, sf), runs=runs, with_bounds=_bounds)


def cascade_status(spark, sf):
    results, _ = _cascaded(spark, sf)
    return results.select("id", "taxonomy_id", "confidence", "object_type", "price_signal", "status", "selected_model", "steps", "decision_reason")


def cascade_attempts(spark, sf):
    _, log = _cascaded(spark, sf)
    return log.groupBy("step_number", "model").agg(F.count("*").alias("attempts"), F.sum("confidence").alias("confidence"))


def reuse_by_hash(spark, sf):
    rows = _scored_rows(spark, sf)
    runs = rows.where(F.col("o_orderpriority") == "1-URGENT").select(
        "id", "input_hash", F.col("nation").cast("string").alias("taxonomy_id_final"), F.lit(90).alias("confidence_final"), F.lit("approved_auto").alias("status_final"), F.lit("m").alias("selected_model")
    )
    out = joins.reuse_by_hash(rows, runs)
    return out.select("id", "reused.run_id", "reused.taxonomy_id_final")


_CASCADE = _TAX_SQL + """,
base AS (
  SELECT o_orderkey AS id, o_totalprice / 1000 AS price, o_orderpriority || '-' || c_nationkey AS input_hash, c_nationkey AS nation, c_acctbal AS balance, o_orderpriority, o_orderstatus
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
runs AS (
  SELECT input_hash, CAST(arg_max(nation, id) AS VARCHAR) AS tid, arg_max(CASE o_orderstatus WHEN 'P' THEN 'pending_review' ELSE 'approved_auto' END, id) AS status, arg_max(o_orderstatus, id) AS model
  FROM base WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' GROUP BY 1),
fresh AS (SELECT * FROM base WHERE input_hash NOT IN (SELECT input_hash FROM runs)),
shifts(step, shift) AS (VALUES (1, 0), (2, 20), (3, 30)),
tries AS (
  SELECT fresh.*, step, greatest(0, least(100, CAST(floor(balance / 100 + shift) AS BIGINT))) AS conf, 'balance ' || shift AS why,
         CASE WHEN nation = 5 OR balance > 9000 THEN 'other' ELSE CAST(nation AS VARCHAR) END AS tid,
         CASE WHEN nation = 5 THEN 'accessory' WHEN nation = 6 THEN 'unknown' ELSE 'console' END AS object_type,
         CASE WHEN nation = 8 THEN 'suspicious_low' ELSE 'compatible' END AS price_signal
  FROM fresh, shifts),
made AS (SELECT * FROM tries t WHERE NOT EXISTS (SELECT 1 FROM tries e WHERE e.id = t.id AND e.step < t.step AND e.conf >= 80)),
final AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step DESC) AS rn FROM made),
judged AS (SELECT *, tid <> 'other' AND (price < 20 OR price > 400 OR price_signal = 'suspicious_low') AS conflict FROM final WHERE rn = 1),
results AS (
  SELECT id, tid AS taxonomy_id, conf AS confidence, object_type, price_signal,
         CASE WHEN conf < 80 OR conflict THEN 'pending_review' WHEN tid = 'other' THEN 'rejected_auto' ELSE 'approved_auto' END AS status,
         'm' || step AS selected_model, step AS steps, why || CASE WHEN conflict THEN ' Price conflict detected by local validation.' ELSE '' END AS decision_reason
  FROM judged
  UNION ALL
  SELECT id, tid, 91, 'console', 'compatible', runs.status, runs.model, 1, 'Reused previous cascade classification for identical input hash.' FROM base JOIN runs USING (input_hash))"""


def needs_model(spark, sf):
    rows = _verifiable(spark, sf).select(
        "id", "last_available", "sold_at", F.when(F.col("verify_status") == "pending", "pending_review").otherwise("approved_auto").alias("ai_status"),
        F.when(F.col("last_price") > 100000, 90.0).alias("ai_confidence"), F.when(F.col("console_family") == "5-LOW", "v1").otherwise("v2").alias("ai_prompt_version"),
    )
    return filters.needs_model(rows, "v2").select("id", "ai_status")


def needs_rules(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_brand") == "Brand#1", "other").otherwise(F.col("p_brand")).alias("console_family"), F.lower("p_type").alias("model_segment"),
        F.when(F.col("p_size") < 5, " ").otherwise("c").alias("canonical_model"), F.when(F.col("p_size") > 45, F.lit(None)).otherwise("rules").alias("classify_method"),
        F.when(F.col("p_type") == "PROMO", "v1").otherwise("v2").alias("classify_version"),
    )
    return filters.needs_rules(rows, "v2").select("id")


def needs_model_sold(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_type") == "PROMO", "ai-cascade:m1").when(F.col("p_type") != "SMALL", F.lower("p_type")).alias("classify_method"),
        F.col("p_type").alias("canonical_model"), (F.col("p_size") / 50).alias("classify_confidence"),
    )
    a = filters.needs_model_sold(rows).select("id", F.lit("cascade").alias("list"))
    return a.unionByName(filters.needs_model_legacy(rows, sold=True).select("id", F.lit("single").alias("list")))


def legacy_classification(spark, sf):
    """Single-step results from customer balances, written into listings."""
    state = ads(spark, sf).select(
        "id", "seller", "console_family", F.lit("old").alias("sub_model"), F.lit("old").alias("canonical_model"), F.lit("standard").alias("edition_class"), "ai_status",
        F.lit(None).cast("double").alias("ai_confidence"), F.lit("rules").alias("classify_method"), F.lit(0.5).alias("classify_confidence"),
    )
    people = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("family"), "c_nationkey", "c_acctbal")
    results = state.select("id", "seller").join(people, F.col("seller") == F.col("c_custkey")).select(
        "id", F.floor(F.col("c_acctbal") / 100).cast("long").alias("console_confidence"), "family", F.lit(None).cast("string").alias("model"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("sub_model"), F.col("c_nationkey").cast("string").alias("canonical"), F.lit("special").alias("edition"),
    )
    out = cascade.apply_legacy_classification(
        state, results, families=["BUILDING", "MACHINERY", "FURNITURE"], sub_models=["n1", "n2", "n3"], canonicals=[str(i) for i in range(20)]
    )
    return out.drop("seller")


_LEGACY = """
r AS (
  SELECT o_orderkey AS id, o_orderpriority AS fam0, CASE o_orderstatus WHEN 'O' THEN 'approved' WHEN 'P' THEN 'pending' ELSE 'approved_auto' END AS st0, c_custkey IS NOT NULL AS hit,
         CAST(floor(c_acctbal / 100) AS BIGINT) AS conf, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN c_mktsegment END AS fam,
         CASE WHEN c_nationkey IN (1, 2, 3) THEN 'n' || c_nationkey END AS sub, CASE WHEN c_nationkey < 20 THEN CAST(c_nationkey AS VARCHAR) END AS can
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
s AS (SELECT *, hit AND conf >= 75 AND fam IS NOT NULL AND can IS NOT NULL AS ok, hit AND conf <= 25 AS no FROM r)
SELECT id, CASE WHEN ok THEN fam WHEN no THEN 'other' ELSE fam0 END AS console_family, CASE WHEN ok THEN coalesce(sub, 'old') WHEN no THEN 'Unknown' ELSE 'old' END AS sub_model,
       CASE WHEN ok THEN can WHEN no THEN 'other' ELSE 'old' END AS canonical_model, CASE WHEN ok THEN 'special' ELSE 'standard' END AS edition_class,
       CASE WHEN NOT hit THEN st0 WHEN conf >= 75 THEN 'approved' WHEN conf <= 25 THEN 'rejected' ELSE 'pending' END AS ai_status,
       CASE WHEN hit THEN conf::DOUBLE END AS ai_confidence, CASE WHEN ok OR no THEN 'ai:v1' ELSE 'rules' END AS classify_method,
       CASE WHEN ok OR no THEN conf / 100.0::DOUBLE ELSE 0.5 END AS classify_confidence
FROM s"""


def set_status(spark, sf):
    """Status updates from order states, of which one is not allowed and some ids are unknown."""
    state = ads(spark, sf).select("id", "ai_status")
    updates = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") * 2).alias("id")).agg(F.max("l_returnflag").alias("f")).select(
        "id", F.when(F.col("f") == "R", "approved").when(F.col("f") == "N", "rejected").otherwise("strange").alias("value")
    )
    out, _ = _set_status(state, updates)
    return out


def set_status_report(spark, sf):
    state = ads(spark, sf).select("id", "ai_status")
    updates = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") * 2).alias("id")).agg(F.max("l_returnflag").alias("f")).select(
        "id", F.when(F.col("f") == "R", "approved").when(F.col("f") == "N", "rejected").otherwise("strange").alias("value")
    )
    return _set_status(state, updates)[1]


def _set_status(state, updates):
    return set_values(state, updates, "id", "ai_status", ("approved", "pending", "rejected"))


_UPDATES = ADS_SQL + """,
updates AS (
  SELECT l_orderkey * 2 AS id, CASE max(l_returnflag) WHEN 'R' THEN 'approved' WHEN 'N' THEN 'rejected' ELSE 'strange' END AS value FROM lineitem GROUP BY 1)"""

QUERIES = {
    "ad_stats": (
        ad_stats,
        f"WITH {ADS_SQL} SELECT count(*) AS total, CAST(sum(last_available) AS BIGINT) AS available, min(last_price) FILTER (last_available = 1 AND last_price > 0) AS min_price, avg(last_price) FILTER (last_available = 1 AND last_price > 0) AS avg_price FROM ads",
    ),
    "sold_stats": (sold_stats, f"WITH {ADS_SQL} SELECT {_SOLD}"),
    "sold_by_family": (sold_by_family, f"WITH {ADS_SQL} SELECT console_family, {_SOLD} GROUP BY console_family"),
    "sold_by_weekday": (sold_by("weekday_idx"), f"WITH {ADS_SQL} SELECT CAST(dayofweek(sold_at) AS BIGINT) AS weekday_idx, count(*) AS count FROM ads WHERE sold_at IS NOT NULL GROUP BY 1"),
    "sold_by_hour": (sold_by_clock("hour"), "SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS count FROM events WHERE event_type = 'error' GROUP BY 1"),
    "sold_by_period": (
        sold_by_clock("period"),
        "SELECT CASE WHEN hour(ts) <= 5 THEN 'night' WHEN hour(ts) <= 11 THEN 'morning' WHEN hour(ts) <= 17 THEN 'afternoon' ELSE 'evening' END AS period, count(*) AS count FROM events WHERE event_type = 'error' GROUP BY 1",
    ),
    "sold_range": (sold_range, f"WITH {_SOLD_DAYS} SELECT id, strftime(day, '%Y-%m-%d') AS day FROM sold WHERE day >= (SELECT max(day) FROM sold) - INTERVAL 364 DAY"),
    "daily_series": (daily_series, f"WITH {_SOLD_DAYS} SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS count, avg(last_price) FILTER (last_price > 0) AS avg_price FROM sold GROUP BY 1"),
    "sold_dashboard": (
        sold_dashboard,
        f"WITH {_SOLD_DAYS}, days AS (SELECT day, count(*) AS c FROM sold GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS total, count(*) AS days, max(c) AS peak_count, sum(c) / count(*) AS avg_per_day, strftime(first(day ORDER BY c DESC, day), '%Y-%m-%d') AS peak_day, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day FROM days",
    ),
    "family_sold_series": (
        family_sold_series,
        f"WITH {_SOLD_DAYS} SELECT console_family, count(*) AS sold, count(DISTINCT day) AS active_days, count(*) FILTER (last_price > 0) AS count, min(last_price) AS min, max(last_price) AS max, avg(last_price) AS avg, stddev_pop(last_price) AS stdev, quantile_cont(last_price, 0.25) AS q1, quantile_cont(last_price, 0.5) AS median, quantile_cont(last_price, 0.75) AS q3 FROM sold WHERE last_price > 0 GROUP BY 1",
    ),
    "listing_view_approved": (listing_view("approved"), f"WITH {ADS_SQL} SELECT id, ai_status, last_price FROM ads WHERE ai_status IN ('approved', 'approved_auto', 'approved_manual') AND last_available = 1 AND sold_at IS NULL"),
    "listing_view_pending": (listing_view("pending"), f"WITH {ADS_SQL} SELECT id, ai_status, last_price FROM ads WHERE ai_status IN ('pending', 'pending_review') AND last_available = 1 AND sold_at IS NULL"),
    "listing_view_sold": (listing_view("sold"), f"WITH {ADS_SQL} SELECT id, ai_status, last_price FROM ads WHERE sold_at IS NOT NULL"),
    "exclude_parts": (market_parts, "SELECT p_partkey AS id, p_name AS name FROM part WHERE NOT regexp_matches(p_name, '(?i)anvil|rott[ao]|old gear')"),
    "listing_filter": (
        listing_filter,
        f"WITH {PLACED_SQL} SELECT id, name, region, last_price FROM placed WHERE (lower(name) LIKE '%0001%' OR lower(regexp_extract(urn_id || '00000', '(\\d{{5,}})$', 1)) LIKE '%0001%') AND console_family = '1-URGENT' AND region = 'NATION_7'",
    ),
    "market_kpis": (
        market_kpis,
        f"WITH {PLACED_SQL} SELECT count(*) AS total, count(DISTINCT console_family || coalesce('/' || seller_type, '')) AS groups, min(last_price) FILTER (last_price > 0) AS min_price, avg(last_price) FILTER (last_price > 0) AS avg_price FROM placed WHERE ai_status IN ('approved', 'approved_auto') AND last_available = 1 AND sold_at IS NULL",
    ),
    "regions": (regions, f"WITH {PLACED_SQL} SELECT DISTINCT region FROM placed WHERE coalesce(region, '') <> ''"),
    "market_order": (
        market_order,
        f"WITH {ADS_SQL} SELECT id, console_family, last_price, row_number() OVER (PARTITION BY console_family ORDER BY last_price, id) AS position FROM ads WHERE ai_status IN ('approved', 'approved_auto') AND last_available = 1 AND sold_at IS NULL",
    ),
    "market_order_sold": (market_order_sold, f"WITH {ADS_SQL} SELECT id, console_family, row_number() OVER (PARTITION BY console_family ORDER BY sold_at DESC, id) AS position FROM ads WHERE sold_at IS NOT NULL"),
    "all_ads": (all_ads, f"WITH {PLACED_SQL} SELECT id, urn_id, name, console_family, region, seller_type, last_price, last_available, ai_status FROM placed"),
    "sold_listings": (sold_listings, f"WITH {ADS_SQL} SELECT id, console_family, strftime(sold_at, '{_TS}') AS sold_at, last_price FROM ads WHERE sold_at IS NOT NULL"),
    "newest_sold": (newest_sold, f"WITH {ADS_SQL} SELECT id, strftime(first_seen, '{_TS}') AS first_seen, last_price FROM (SELECT * FROM ads WHERE sold_at IS NOT NULL ORDER BY first_seen DESC, id LIMIT 200) x"),
    "active_ads": (active_ads, f"WITH {ADS_SQL} SELECT id, console_family, last_price FROM ads WHERE last_available = 1 AND last_seen >= DATE '2001-08-01' - INTERVAL 400 DAY"),
    "duration_text": (
        duration,
        f"WITH {ADS_SQL}, h AS (SELECT id, (epoch_us(sold_at) - epoch_us(published_at)) / 3600000000 AS h FROM ads WHERE sold_at IS NOT NULL) SELECT id, CASE WHEN h < 48 THEN CAST(round_even(h, 0) AS BIGINT) || ' ore' ELSE CAST(round_even(h / 24, 0) AS BIGINT) || ' giorni' END AS on_sale FROM h",
    ),
    "topic_match": (topic_match, f"WITH {_VERIFIABLE} SELECT id, {_TOPIC} AS on_topic FROM verifiable"),
    "selection_funnel": (
        selection_funnel,
        f"WITH {_VERIFIABLE}, f AS (SELECT count(*) AS total_ads, count(*) AS status_ok, count(*) FILTER (last_available = 1 AND sold_at IS NULL) AS active_unsold, count(*) FILTER (last_available = 1 AND sold_at IS NULL AND {_TOPIC}) AS topic_subset FROM verifiable) SELECT *, active_unsold - topic_subset AS excluded_by_topic FROM f",
    ),
    "selection_priority": (
        selection_priority,
        f"WITH {_VERIFIABLE} SELECT id, verify_status, strftime(last_seen, '{_TS}') AS last_seen FROM (SELECT * FROM verifiable WHERE last_available = 1 AND sold_at IS NULL AND {_TOPIC} ORDER BY CASE verify_status WHEN 'pending' THEN 0 ELSE 1 END, last_seen, id) x",
    ),
    "selection_stale": (
        selection_stale,
        f"WITH {_VERIFIABLE} SELECT id, 1 AS tier FROM verifiable WHERE last_available = 1 AND sold_at IS NULL AND {_TOPIC} AND (verify_status = 'pending' OR last_verified_at IS NULL OR last_verified_at < {_NOW} - INTERVAL 90 DAY) UNION ALL SELECT id, 3 AS tier FROM verifiable WHERE {_TOPIC} AND sold_at >= {_NOW} - INTERVAL 120 DAY",
    ),
    "selection_tiers": (
        selection_sample,
        f"WITH {_VERIFIABLE}, o AS (SELECT *, last_verified_at >= {_NOW} - INTERVAL 90 DAY AS fresh FROM verifiable WHERE last_available = 1 AND sold_at IS NULL AND {_TOPIC}) SELECT 1 AS tier, count(*) AS rows, count(*) AS distinct_rows FROM o WHERE verify_status = 'pending' OR NOT coalesce(fresh, false) UNION ALL SELECT 2, CAST(floor(count(*) * 0.3::DOUBLE) AS BIGINT), CAST(floor(count(*) * 0.3::DOUBLE) AS BIGINT) FROM o WHERE fresh HAVING floor(count(*) * 0.3::DOUBLE) > 0",
    ),
    "excluded_sample": (excluded_sample, f"WITH {_VERIFIABLE} SELECT id, name FROM (SELECT * FROM verifiable WHERE last_available = 1 AND sold_at IS NULL AND NOT {_TOPIC} ORDER BY last_seen DESC, id LIMIT 50) x"),
    "random_probe": (
        random_probe,
        f"WITH {_VERIFIABLE} SELECT id, urn_id FROM (SELECT * FROM verifiable WHERE last_available = 1 AND sold_at IS NULL ORDER BY md5(id || ':7'), id LIMIT 10) x",
    ),
    "outcomes": (outcomes, f"WITH {_OUTCOMES.format(**_RATIOS)} SELECT id, chunk, reason, outcome FROM outcomes"),
    "reason_counts": (reason_counts, f"WITH {_OUTCOMES.format(**_RATIOS)} SELECT chunk, reason, count(*) AS count FROM outcomes GROUP BY 1, 2"),
    "top_reasons": (top_reasons, f"WITH {_OUTCOMES.format(**_RATIOS)} SELECT reason, count(*) AS count FROM outcomes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4"),
    "unstable_hits": (unstable_hits, f"WITH {_OUTCOMES.format(**_RATIOS)} SELECT count(*) FILTER (reason LIKE 'blocked:%' OR reason LIKE '%http-403%' OR reason = 'skipped:cffi-block') AS unstable_hits FROM outcomes"),
    "apply_verification": (apply_verification, f"WITH {_APPLY}"),
    "verification_changes": (
        verification_changes,
        f"WITH {_VERIFIED} SELECT id AS ad_id, last_price AS price_old, last_price AS price_new, 1 AS available_old, 0 AS available_new, 'availability' AS change_type FROM v2 WHERE outcome = 'sold' AND last_available = 1",
    ),
    "verification_summary": (
        verification_summary,
        f"WITH {_VERIFIED}, s AS (SELECT {_SUMMARY_COLS} FROM v2 WHERE outcome IS NOT NULL) SELECT *, verified / attempted AS coverage_ratio, blocked_403 / attempted AS blocked_403_ratio, blocked_total / attempted AS blocked_total_ratio FROM s",
    ),
    "verification_chunks": (
        verification_chunks,
        f"WITH {_VERIFIED}, s AS (SELECT chunk, {_SUMMARY_COLS} FROM v2 WHERE outcome IS NOT NULL GROUP BY chunk) SELECT chunk, attempted, verified, sold, blocked_403, verified / attempted AS coverage_ratio FROM s",
    ),
    "taxonomy_join": (
        taxonomy_join,
        f"WITH {_TAX_SQL} SELECT c_custkey AS id, tid AS tax_id, type AS tax_type, family AS tax_family, label AS tax_label FROM customer LEFT JOIN tax ON tid = CASE WHEN c_acctbal < 0 THEN '3' ELSE CAST(c_nationkey AS VARCHAR) END",
    ),
    "fields_of": (
        fields_of,
        f"WITH {_TAX_SQL} SELECT c_custkey AS id, coalesce(family_key, 'other') AS console_family, CASE WHEN tid IS NULL THEN 'Unknown' ELSE 'Base' END AS sub_model, CASE WHEN tid IS NULL THEN 'unknown' WHEN type = 'Speciale' THEN 'premium' ELSE 'base' END AS model_segment, CASE WHEN type = 'Speciale' THEN 'special' ELSE 'standard' END AS edition_class, coalesce(tid, 'other') AS canonical_model FROM customer LEFT JOIN tax ON tid = CASE WHEN c_acctbal < 0 THEN 'other' ELSE CAST(c_nationkey AS VARCHAR) END",
    ),
    "taxonomy_ids": (taxonomy_ids, "SELECT CAST(c_nationkey AS VARCHAR) AS tid, count(*) AS rows FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation) GROUP BY 1"),
    "latest_per_key": (latest_run_per_ad, f"WITH {_LATEST} SELECT ad_id, selected_model, created_at FROM newest"),
    "pending_reviews": (
        pending_reviews,
        f"WITH {ADS_SQL},{_LATEST} SELECT id, ai_confidence, selected_model, created_at AS classified_at FROM (SELECT ads.id, round(c_acctbal / 100) + 0.0 AS ai_confidence, selected_model, created_at FROM ads LEFT JOIN customer ON seller = c_custkey LEFT JOIN newest ON ad_id = ads.id WHERE ai_status = 'pending' AND last_available = 1 AND sold_at IS NULL ORDER BY 2 DESC NULLS LAST, 1 DESC) x",
    ),
    "apply_review": (
        apply_review,
        f"WITH {_REVIEW} SELECT doc_id AS id, coalesce(human, source) AS ai_taxonomy_id, coalesce(status, 'pending_review') AS ai_status, CASE WHEN human IS NULL THEN lang ELSE coalesce(family_key, 'other') END AS console_family, CASE WHEN human IS NULL THEN 'base' WHEN tid IS NULL THEN 'Unknown' ELSE 'Base' END AS sub_model, CASE WHEN human IS NULL THEN 'base' WHEN tid IS NULL THEN 'unknown' WHEN type = 'Speciale' THEN 'premium' ELSE 'base' END AS model_segment, CASE WHEN human IS NOT NULL AND type = 'Speciale' THEN 'special' ELSE 'standard' END AS edition_class, CASE WHEN human IS NULL THEN 'unknown' ELSE coalesce(tid, 'other') END AS canonical_model, CASE WHEN human IS NULL THEN 'rules' ELSE 'human-review:v1' END AS classify_method, CASE WHEN human IS NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS classify_confidence FROM documents LEFT JOIN good ON doc_id = ad_id LEFT JOIN tax ON tid = human",
    ),
    "review_audit": (
        review_audit,
        f"WITH {_REVIEW} SELECT good.ad_id, run_id, source AS ai_taxonomy_id, human AS human_taxonomy_id, status AS human_status, 'label' AS review_reason FROM good JOIN documents ON doc_id = good.ad_id LEFT JOIN last_runs ON last_runs.ad_id = good.ad_id",
    ),
    "review_errors": (review_errors, f"WITH {_REVIEW} SELECT ad_id, human AS human_taxonomy_id, 'invalid taxonomy_id' AS error FROM decided WHERE human = 'none'"),
    "cascade_status": (cascade_status, f"WITH {_CASCADE} SELECT id, taxonomy_id, confidence, object_type, price_signal, status, selected_model, steps, decision_reason FROM results"),
    "cascade_attempts": (
        cascade_attempts,
        f"WITH {_CASCADE} SELECT step AS step_number, 'm' || step AS model, count(*) AS attempts, CAST(sum(conf) AS BIGINT) AS confidence FROM made GROUP BY 1, 2 UNION ALL SELECT 1, 'reuse', count(*), CAST(91 * count(*) AS BIGINT) FROM base JOIN runs USING (input_hash)",
    ),
    "reuse_by_hash": (
        reuse_by_hash,
        f"WITH {_CASCADE}, r AS (SELECT input_hash, max(id) AS run_id, CAST(arg_max(nation, id) AS VARCHAR) AS taxonomy_id_final FROM base WHERE o_orderpriority = '1-URGENT' GROUP BY 1) SELECT id, run_id, taxonomy_id_final FROM base LEFT JOIN r USING (input_hash)",
    ),
    "needs_model": (
        needs_model,
        f"WITH {_VERIFIABLE} SELECT id, CASE WHEN verify_status = 'pending' THEN 'pending_review' ELSE 'approved_auto' END AS ai_status FROM verifiable WHERE last_available = 1 AND sold_at IS NULL AND (verify_status = 'pending' OR last_price <= 100000 OR console_family = '5-LOW')",
    ),
    "needs_rules": (needs_rules, "SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#1' OR p_size < 5 OR p_size > 45 OR p_type = 'PROMO'"),
    "needs_model_sold": (
        needs_model_sold,
        "SELECT p_partkey AS id, 'cascade' AS list FROM part WHERE p_type <> 'PROMO' UNION ALL SELECT p_partkey, 'single' FROM part WHERE p_size / 50 < 0.6",
    ),
    "legacy_classification": (legacy_classification, f"WITH {_LEGACY}"),
    "set_status": (
        set_status,
        f"WITH {_UPDATES} SELECT ads.id, CASE WHEN value IN ('approved', 'rejected') THEN value ELSE ai_status END AS ai_status FROM ads LEFT JOIN updates USING (id)",
    ),
    "set_status_report": (
        set_status_report,
        f"WITH {_UPDATES} SELECT updates.id, value, o_orderkey IS NOT NULL AND value <> 'strange' AS applied FROM updates LEFT JOIN orders ON o_orderkey = updates.id",
    ),
}
