"""Valuation, deals, statistics over price observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.bindings.roles import (
    ADS_SQL, FACT_ID, FACT_SQL, LOG_SQL, active_listings, ads, change_log, fact, offers, show_day, show_ts, stamp, table,
)
from marketlens.functions import scores
from marketlens.operators import aggregates, joins, ordering, windows
from marketlens.plans import alerts, statistics, valuation

ID_SQL = ", ".join(FACT_ID)
_BUCKETS = FACT_SQL + f""",
buckets AS (
  SELECT CASE WHEN canonical_model IS NOT NULL THEN canonical_model ELSE 'family:' || console_family END AS key,
         source, price, console_family AS family, {ID_SQL}
  FROM fact WHERE (source = 'ebay' OR available = 1) AND price > 0),
med AS (
  SELECT key, source, median(price) AS m, count(*) AS n, first(family ORDER BY {ID_SQL}) AS family
  FROM buckets GROUP BY key, source),
wide AS (
  SELECT key,
         coalesce(max(family) FILTER (source = 'cex'), max(family) FILTER (source = 'subito'), max(family) FILTER (source = 'ebay')) AS console_family,
         max(m) FILTER (source = 'cex') * 0.78 AS cex_net, max(m) FILTER (source = 'ebay') AS ebay_median, max(m) FILTER (source = 'subito') AS subito_median,
         coalesce(max(n) FILTER (source = 'cex'), 0) AS cex_n, coalesce(max(n) FILTER (source = 'ebay'), 0) AS ebay_n, coalesce(max(n) FILTER (source = 'subito'), 0) AS subito_n
  FROM med GROUP BY key)"""


def _fair(cex: str, ebay: str, subito: str, name: str = "fair") -> str:
    def part(w: str, c: str) -> str:
        return f"CASE WHEN {c} IS NOT NULL THEN {w} * {c} ELSE 0 END"

    def used(w: str, c: str) -> str:
        return f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0 END"

    pairs = [(cex, "cex_net"), (ebay, "ebay_median"), (subito, "subito_median")]
    total = " + ".join(part(w, c) for w, c in pairs)
    weight = " + ".join(used(w, c) for w, c in pairs)
    count = " + ".join(f"({c} IS NOT NULL)::INT" for _, c in pairs)
    return f""",
{name} AS (
  SELECT key, console_family, CASE WHEN key NOT LIKE 'family:%' THEN key END AS canonical_model,
         CASE WHEN key LIKE 'family:%' THEN substr(key, 8) ELSE console_family END AS fallback_family_key,
         ({total}) / ({weight}) AS fair_value,
         CASE WHEN {count} >= 2 THEN greatest(cex_net, ebay_median, subito_median) - least(cex_net, ebay_median, subito_median) ELSE 0 END AS spread,
         least(1.0::DOUBLE, 0.3::DOUBLE + 0.18::DOUBLE * ({count}) + least(cex_n + ebay_n + subito_n, 60) * 0.006::DOUBLE) AS confidence,
         CAST(cex_n + ebay_n + subito_n AS BIGINT) AS sample_count, cex_n, ebay_n, subito_n, cex_net, ebay_median, subito_median
  FROM wide WHERE ({weight}) > 0)"""


_FAIR = _BUCKETS + _fair("0.45::DOUBLE", "0.35::DOUBLE", "0.20::DOUBLE")
_FAIR_COLS = (
    "key, console_family, canonical_model, fallback_family_key, fair_value, spread, confidence, sample_count, cex_n, ebay_n, subito_n, "
    "cex_net, ebay_median, subito_median"
)


def fair_values(spark, sf):
    return valuation.fair_values(offers(spark, sf))


def fair_values_listing_only(spark, sf):
    return valuation.fair_values(offers(spark, sf), {"cex": 0.9, "subito": 0.1}, include_ebay=False)


def opportunities(spark, sf):
    values = valuation.fair_values(offers(spark, sf))
    scored = valuation.score_opportunities(active_listings(spark, sf), values, tie=FACT_ID)
    return scored.select(*FACT_ID[:4], "console_family", "canonical_model", "last_price", "fair_value", "delta_pct", "quality_score", "opportunity_score", "confidence")


_OPPORTUNITIES = _FAIR + f""",
picked AS (
  SELECT * FROM fact WHERE source = 'subito' AND available = 1 AND price > 0),
by_family AS (
  SELECT fallback_family_key AS fam, fair_value, confidence,
         row_number() OVER (PARTITION BY fallback_family_key ORDER BY round(confidence, 3) DESC, sample_count DESC, console_family, key) AS rn
  FROM fair),
valued AS (
  SELECT p.*, coalesce(m.fair_value, f.fair_value) AS fair_value, coalesce(m.confidence, f.confidence) AS confidence
  FROM picked p LEFT JOIN fair m ON p.canonical_model = m.canonical_model
  LEFT JOIN (SELECT * FROM by_family WHERE rn = 1) f ON p.console_family = f.fam
  WHERE coalesce(m.fair_value, f.fair_value) IS NOT NULL),
scored AS (
  SELECT *, CASE WHEN fair_value > 0 THEN (fair_value - price) / fair_value * 100 ELSE 0 END AS delta_pct,
         greatest(0.0::DOUBLE, least(100.0::DOUBLE, 45.0 + CASE WHEN size > 25 THEN 12 ELSE 0 END + CASE WHEN size > 10 THEN 5 ELSE 0 END + 4
           + CASE WHEN size > 40 THEN 6 ELSE 0 END + 8 - CASE WHEN price < fair_value * 0.45 THEN 18 ELSE 0 END)) AS quality_score
  FROM valued)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, console_family, canonical_model, price AS last_price, fair_value, delta_pct,
       CAST(quality_score AS DOUBLE) AS quality_score,
       greatest(0.0::DOUBLE, least(100.0::DOUBLE, delta_pct * 0.7 + quality_score * 0.3)) AS opportunity_score, confidence
FROM scored"""


def backtest(spark, sf):
    return valuation.backtest(offers(spark, sf))[0]


def worst_errors(spark, sf):
    return valuation.worst_errors(valuation.backtest(offers(spark, sf))[1])


_PAIRS = _BUCKETS + _fair("(0.45 / 0.65)::DOUBLE", "0.0::DOUBLE", "(0.20 / 0.65)::DOUBLE").replace(
    "CASE WHEN ebay_median IS NOT NULL THEN 0.0::DOUBLE * ebay_median ELSE 0 END", "0"
) + """,
pairs AS (
  SELECT key, console_family, fair_value AS predicted, ebay_median AS actual,
         abs(ebay_median - fair_value) / fair_value * 100 AS error_pct, abs(ebay_median - fair_value) AS error_abs
  FROM fair WHERE fair_value > 0 AND ebay_median IS NOT NULL)"""


def tune_weights(spark, sf):
    return valuation.tune_weights(offers(spark, sf))


_TUNE = _BUCKETS + """,
grid AS (SELECT x / 100.0::DOUBLE AS cex_weight, 1.0::DOUBLE - x / 100.0::DOUBLE AS subito_weight FROM range(20, 91, 5) t(x)),
priced AS (
  SELECT cex_weight, subito_weight, ebay_median,
         (CASE WHEN cex_net IS NOT NULL THEN cex_weight * cex_net ELSE 0 END + CASE WHEN subito_median IS NOT NULL THEN subito_weight * subito_median ELSE 0 END)
         / (CASE WHEN cex_net IS NOT NULL THEN cex_weight ELSE 0 END + CASE WHEN subito_median IS NOT NULL THEN subito_weight ELSE 0 END) AS predicted
  FROM wide, grid WHERE ebay_median IS NOT NULL AND (cex_net IS NOT NULL OR subito_median IS NOT NULL))
SELECT cex_weight, subito_weight, count(*) AS count, avg(abs(ebay_median - predicted) / predicted * 100) AS mape, avg(abs(ebay_median - predicted)) AS mae
FROM priced WHERE predicted > 0 GROUP BY cex_weight, subito_weight"""


def explain_values(spark, sf):
    values = valuation.fair_values(offers(spark, sf))
    out = valuation.explain_values(values)
    # The figures inside the sentence are rounded; compare it with them taken out.
    return out.select("key", "console_family", "fair_value", "confidence", F.regexp_replace("explanation", r"\d+\.\d+", "#").alias("explanation"))


_EXPLAIN = _FAIR + """
SELECT key, console_family, fair_value, confidence,
       'Fair value # EUR da CEX net=' || CASE WHEN cex_net IS NULL THEN 'None' ELSE '#' END || ' (n=' || cex_n || '), eBay=' ||
       CASE WHEN ebay_median IS NULL THEN 'None' ELSE '#' END || ' (n=' || ebay_n || '), Subito=' ||
       CASE WHEN subito_median IS NULL THEN 'None' ELSE '#' END || ' (n=' || subito_n || '); conf=#, spread=#.' AS explanation
FROM fair"""


def trimmed_mean(spark, sf):
    return ordering.trimmed_mean(fact(spark, sf), ["console_family"], "price")


_TRIMMED = FACT_SQL + """,
ranked AS (
  SELECT console_family, price, row_number() OVER (PARTITION BY console_family ORDER BY price) AS rn, count(*) OVER (PARTITION BY console_family) AS n
  FROM fact),
cuts AS (SELECT *, CASE WHEN n < 6 THEN 0 ELSE CAST(floor(n * 0.15::DOUBLE) AS BIGINT) END AS cut FROM ranked)
SELECT console_family, max(n) AS n, CAST(max(n) - 2 * max(cut) AS BIGINT) AS kept, avg(price) AS trimmed_mean
FROM cuts WHERE rn > cut AND rn <= n - cut GROUP BY console_family"""


def price_summary(spark, sf):
    return aggregates.price_summary(fact(spark, sf), ["console_family", "source"], "price")


_SUMMARY = FACT_SQL + """
SELECT console_family, source, count(*) AS count, min(price) AS min, max(price) AS max, avg(price) AS avg, stddev_pop(price) AS stdev,
       quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS q3
FROM fact WHERE price > 0 GROUP BY console_family, source"""


def _deals_input(spark, sf):
    rows = offers(spark, sf).withColumn("last_price", F.col("price")).withColumn("last_available", F.col("available"))
    return rows.withColumn("is_base_model", F.when(F.col("size") > 40, 1).otherwise(0))


def thresholds(spark, sf):
    return aggregates.deal_thresholds(_deals_input(spark, sf))


_THRESHOLDS = FACT_SQL + """,
thresholds AS (
  SELECT console_family, coalesce(min(price) FILTER (size > 40), min(price)) * 0.78 AS threshold
  FROM fact WHERE source = 'cex' AND price > 0 AND available = 1 GROUP BY console_family)"""
_URN = "'L' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT)"


def _urn():
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return F.concat(F.lit("L"), F.concat_ws("-", *[F.col(c).cast("string") for c in FACT_ID[:4]], cents.cast("string")))


def _deal_ads(spark, sf):
    return active_listings(spark, sf).withColumn("urn_id", _urn()).withColumn("ai_status", F.lit("approved")).withColumn(
        # Prices of open lines rarely fall below the lowest store price, so they are scaled down.
        "last_price", F.col("last_price") * 0.1
    )


def _announced(spark, sf):
    """Listings announced before: the open lines shipped by the end of 1995, stamped with that day."""
    return fact(spark, sf).where((F.col("source") == "subito") & (F.col("ts") < F.lit("1996-01-01").cast("timestamp_ntz"))).select(
        _urn().alias("urn_id"), F.concat(show_day("ts"), F.lit("T00:00:00+00:00")).alias("ts")
    )


_ALERT_AS_OF = "1996-02-15 00:00:00"


def deals(spark, sf):
    limits = aggregates.deal_thresholds(_deals_input(spark, sf))
    announcements, _ = alerts.check_alerts(
        _deal_ads(spark, sf).withColumn("id", F.struct(*FACT_ID)), limits, _announced(spark, sf), stamp(_ALERT_AS_OF), F.lit("1996-02-15T00:00:00+00:00")
    )
    return announcements.select("urn_id", "console_family", "last_price", "threshold", "sent", F.regexp_replace("message", r"\d+", "#").alias("message"))


_DEALS = _THRESHOLDS + f""",
announced AS (SELECT {_URN} AS urn_id, ts FROM fact WHERE source = 'subito' AND ts < TIMESTAMP '1996-01-01'),
kept AS (SELECT * FROM announced WHERE ts >= TIMESTAMP '{_ALERT_AS_OF}' - INTERVAL 90 DAY),
live AS (
  SELECT *, {_URN} AS urn_id, price * 0.1::DOUBLE AS last_price FROM fact WHERE source = 'subito' AND available = 1 AND price > 0),
deals AS (
  SELECT live.*, threshold FROM live JOIN thresholds USING (console_family)
  WHERE last_price < threshold AND urn_id NOT IN (SELECT urn_id FROM kept))"""


def alert_log(spark, sf):
    limits = aggregates.deal_thresholds(_deals_input(spark, sf))
    _, log = alerts.check_alerts(
        _deal_ads(spark, sf).withColumn("id", F.struct(*FACT_ID)), limits, _announced(spark, sf), stamp(_ALERT_AS_OF), F.lit("1996-02-15T00:00:00+00:00")
    )
    return log


def z_score(spark, sf):
    return statistics.z_score_of_min(fact(spark, sf), "console_family", "price")


def spread(spark, sf):
    return statistics.bid_ask_spread(fact(spark, sf), "console_family", "price")


def _daily(spark, sf):
    return windows.daily_min(change_log(spark, sf), "product_id", "changed_at", "price_new")


_DAILY = LOG_SQL + """,
daily AS (SELECT product_id, CAST(changed_at AS DATE) AS day, min(price_new) AS price FROM log WHERE price_new > 0 GROUP BY 1, 2),
series AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY day) - 1 AS x, count(*) OVER (PARTITION BY product_id) AS n FROM daily)"""


def daily_min_price(spark, sf):
    return _daily(spark, sf).select("product_id", show_day("day").alias("day"), "price")


def slope(spark, sf):
    return statistics.linear_slope(_daily(spark, sf), "product_id")


def ema(spark, sf):
    return windows.ema(_daily(spark, sf), "product_id")


_EMA = _DAILY + """
SELECT product_id, max(n) AS days,
       CASE WHEN max(n) >= 2 THEN sum(price * CASE WHEN x = 0 THEN pow(0.75::DOUBLE, n - 1) ELSE 0.25::DOUBLE * pow(0.75::DOUBLE, n - 1 - x) END) END AS ema
FROM series GROUP BY product_id"""


def price_trend(spark, sf):
    return statistics.price_trend(_daily(spark, sf), "product_id", F.lit("2024-01-10").cast("date"))


def stockout(spark, sf):
    log = change_log(spark, sf)
    return statistics.stockout_probability(log.withColumn("grp", F.col("product_id")), "grp", "product_id", "changed_at", "available_new", "id", stamp("2024-02-01"))


_STOCKOUT = LOG_SQL + """,
steps AS (SELECT *, lag(available_new) OVER (PARTITION BY product_id ORDER BY changed_at, id) AS before FROM log),
g AS (
  SELECT product_id AS grp, CAST(count(*) FILTER (before = 1 AND available_new = 0) AS BIGINT) AS events, min(changed_at) AS first
  FROM steps GROUP BY product_id)
SELECT grp, events, 1 - exp(-(events / greatest(1.0::DOUBLE, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(first)) / 86400000000.0::DOUBLE))) AS stockout_probability
FROM g"""


def transitions(spark, sf):
    rows = windows.availability_transitions(change_log(spark, sf), "product_id", "changed_at", "available_new", "id")
    return rows.select("id", "product_id", show_ts("changed_at").alias("changed_at"))


def ci95(spark, sf):
    return statistics.mean_ci95(fact(spark, sf), "console_family", "price")


def premium(spark, sf):
    rows = fact(spark, sf).select(
        F.concat_ws("|", "console_family", F.col("size").cast("string"), F.coalesce("canonical_model", F.lit("SMALL"))).alias("combo"),
        "console_family", "size", F.coalesce("canonical_model", F.lit("SMALL")).alias("edition"), "price",
    )
    return statistics.shrunk_premium(rows, "combo", ["console_family", "size"], F.col("edition") == "STANDARD", "price")


_PREMIUM = FACT_SQL + """,
rows AS (SELECT console_family || '|' || size || '|' || coalesce(canonical_model, 'SMALL') AS combo, console_family, size, coalesce(canonical_model, 'SMALL') AS edition, price FROM fact WHERE price > 0),
std AS (SELECT console_family, size, avg(price) AS std FROM rows WHERE edition = 'STANDARD' GROUP BY 1, 2),
own AS (SELECT combo, console_family, size, count(*) AS n, avg(price) AS mean FROM rows GROUP BY 1, 2, 3)
SELECT combo, console_family, size, n, (n * (mean - std) + 3 * 30.0::DOUBLE) / (n + 3) AS premium FROM own JOIN std USING (console_family, size)"""


def storage_corr(spark, sf):
    return statistics.storage_correlation(fact(spark, sf), ["console_family"], "size", "price")


def feature_value(spark, sf):
    rows = fact(spark, sf).withColumn("flag", F.when(F.contains("name", F.lit("red")), 1).when(F.contains("name", F.lit("blue")), 0))
    return statistics.feature_value(rows, "console_family", "flag", "price")


def kmeans_1d(spark, sf):
    return statistics.kmeans_1d(fact(spark, sf), "source", "price")


def model_statistics(spark, sf):
    rows = fact(spark, sf)
    items = rows.select(
        F.col("console_family").alias("combo_key"), "source", "price", F.col("console_family").alias("family"), F.coalesce("canonical_model", F.lit("SMALL")).alias("segment"),
        F.lit("one").alias("storage"), F.col("size").alias("storage_gb"), F.when(F.col("size") < 30, "standard").otherwise("special").alias("edition"),
        F.when(F.contains("name", F.lit("red")), 1).when(F.contains("name", F.lit("blue")), 0).alias("has_kinect"),
    ).withColumn("segment", F.lit("all"))
    log = rows.select(
        F.col("console_family").alias("combo_key"), F.col("l_partkey").alias("product_id"), F.col("ts").alias("changed_at"), F.col("price").alias("price_new"),
        F.col("available").alias("available_new"), F.struct(*FACT_ID).alias("change_id"),
    )
    out = statistics.model_statistics(items, log, stamp("2001-12-01"))
    return out.drop("bands", "volatile")


_DAY0 = "epoch_us(TIMESTAMP '2001-12-01')"
_MODEL_STATS = FACT_SQL + f""",
basic AS (
  SELECT console_family AS combo_key, count(*) AS n, min(price) AS min_price, (min(price) - avg(price)) / stddev_samp(price) AS z_score,
         min(price) FILTER (source = 'cex') - avg(price) FILTER (source <> 'cex') AS spread, 1.96 * stddev_samp(price) / sqrt(count(*)) AS margin,
         corr(size, price) AS correlation, avg(price) FILTER (name LIKE '%red%') - avg(price) FILTER (name NOT LIKE '%red%' AND name LIKE '%blue%') AS feature_value,
         (count(*) * (avg(price) - avg(price) FILTER (size < 30)) + 90.0) / (count(*) + 3) AS premium
  FROM fact GROUP BY 1),
daily AS (SELECT console_family AS combo_key, CAST(ts AS DATE) AS day, min(price) AS price FROM fact GROUP BY 1, 2),
series AS (SELECT *, row_number() OVER (PARTITION BY combo_key ORDER BY day) - 1 AS x, count(*) OVER (PARTITION BY combo_key) AS n FROM daily),
lines AS (
  SELECT combo_key, regr_slope(price, x) AS slope,
         sum(price * CASE WHEN x = 0 THEN pow(0.75::DOUBLE, n - 1) ELSE 0.25::DOUBLE * pow(0.75::DOUBLE, n - 1 - x) END) AS ema
  FROM series GROUP BY 1),
steps AS (SELECT console_family, available, ts, lag(available) OVER (PARTITION BY l_partkey ORDER BY ts, {ID_SQL}) AS before FROM fact),
gone AS (
  SELECT console_family AS combo_key,
         1 - exp(-(count(*) FILTER (before = 1 AND available = 0) / greatest(1.0::DOUBLE, ({_DAY0} - epoch_us(min(ts))) / 86400000000.0::DOUBLE))) AS stockout_probability
  FROM steps GROUP BY 1)
SELECT combo_key, combo_key AS family, 'all' AS segment, n, min_price, z_score, spread, ema, slope, stockout_probability, premium, margin, correlation, feature_value
FROM basic JOIN lines USING (combo_key) JOIN gone USING (combo_key)"""


def family_average(spark, sf):
    return aggregates.family_average(ads(spark, sf), 35000.0)


def deal_bands(spark, sf):
    rows = ads(spark, sf)
    averages = aggregates.family_average(rows, 35.0)
    banded = joins.opportunity_badges(rows, _order_opportunities(spark, sf), averages)
    return banded.select("id", "console_family", "band", "quality_band")


def _order_opportunities(spark, sf):
    """Scored listings: orders with urgent priority, their discount standing in for the delta."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.avg(F.col("l_discount") * 400).alias("delta_pct"), F.max("l_quantity").alias("quality_score"))
    orders = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.round("delta_pct", 6).alias("delta_pct"), (F.col("quality_score") * 2).alias("quality_score"))


_BAND = "CASE WHEN {d} >= 30 THEN 'fire' WHEN {d} >= 20 THEN 'great' WHEN {d} >= 10 THEN 'ok' WHEN {d} <= -15 THEN 'over' ELSE 'none' END"
_DEAL_BANDS = ADS_SQL + """,
averages AS (SELECT coalesce(nullif(trim(console_family), ''), 'other') AS family, avg(last_price) AS avg_price FROM ads WHERE last_available = 1 AND last_price >= 35 GROUP BY 1),
opp AS (
  SELECT o_orderkey AS id, round(avg(l_discount * 400), 6) AS delta, max(l_quantity) * 2 AS quality
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
joined AS (
  SELECT ads.id, ads.console_family, delta, quality, CASE WHEN last_price > 0 THEN (avg_price - last_price) / avg_price * 100 END AS d
  FROM ads LEFT JOIN opp USING (id) LEFT JOIN averages ON averages.family = coalesce(nullif(trim(ads.console_family), ''), 'other'))
SELECT id, console_family, CASE WHEN delta IS NOT NULL THEN """ + _BAND.format(d="delta") + " WHEN d <= 60 THEN " + _BAND.format(d="d") + """ ELSE 'none' END AS band,
       CASE WHEN delta IS NOT NULL THEN CASE WHEN quality >= 75 THEN 'high' WHEN quality >= 55 THEN 'medium' ELSE 'low' END END AS quality_band
FROM joined"""


def family_store_matrix(spark, sf):
    rows = fact(spark, sf).withColumn("condition", F.when(F.col("size") > 25, "Nuovo").otherwise("Usato"))
    return aggregates.family_store_matrix(rows, ["cex", "ebay", "subito"])


def _matrix_sql() -> str:
    cells = ",\n".join(
        f"count(*) FILTER (source = '{s}' AND available = 1) AS {s}_available, min(price) FILTER (source = '{s}' AND available = 1) AS {s}_min_price, count(*) FILTER (source = '{s}') AS {s}_total"
        for s in ("cex", "ebay", "subito")
    )
    return f"WITH {FACT_SQL} SELECT console_family, {cells}, avg(price) FILTER (available = 1 AND size <= 25) AS ref_used, avg(price) FILTER (available = 1 AND size > 25) AS ref_new FROM fact GROUP BY 1"


def store_card_counts(spark, sf):
    return aggregates.store_card_counts(fact(spark, sf))


def store_stats(spark, sf):
    return aggregates.store_stats(fact(spark, sf).where(F.col("source") == "ebay"), "console_family", "price")


def global_counts(spark, sf):
    return aggregates.global_counts(fact(spark, sf))


def price_buckets(spark, sf):
    rows = valuation.price_buckets(offers(spark, sf))
    return rows.groupBy("key", "source").agg(F.count("*").alias("n"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))


def weights_of_sources(spark, sf):
    """Resolved weights next to the rows each source has."""
    w = scores.resolve_weights({"cex": 2.0, "subito": 1.0}, include_ebay=False)
    counted = fact(spark, sf).groupBy("source").agg(F.count("*").alias("rows"))
    return counted.withColumn("weight", scores.lookup(w, F.col("source")))


#: Three centroids per source, round by round until none moves by more than 0.1.
_KMEANS = """
pts AS (SELECT source, CAST(price AS DOUBLE) AS p, count(*) AS c FROM fact WHERE price > 0 GROUP BY 1, 2),
sizes AS (SELECT source, sum(c) AS n, min(p) AS lo, max(p) AS hi FROM pts GROUP BY 1),
r AS (
    SELECT source, 0 AS turn, lo AS m0, lo + (hi - lo) * 0.5::DOUBLE AS m1, hi AS m2, lo AS u0, lo AS u1, hi AS u2, true AS moved FROM sizes WHERE n >= 3
    UNION ALL
    SELECT source, turn + 1, CASE WHEN abs(a0 - m0) > 0.1 THEN a0 ELSE m0 END, CASE WHEN abs(a1 - m1) > 0.1 THEN a1 ELSE m1 END,
           CASE WHEN abs(a2 - m2) > 0.1 THEN a2 ELSE m2 END, m0, m1, m2,
           coalesce(abs(a0 - m0) > 0.1, false) OR coalesce(abs(a1 - m1) > 0.1, false) OR coalesce(abs(a2 - m2) > 0.1, false)
    FROM (
        SELECT source, turn, m0, m1, m2, sum(p * c) FILTER (j = 0) / sum(c) FILTER (j = 0) AS a0,
               sum(p * c) FILTER (j = 1) / sum(c) FILTER (j = 1) AS a1, sum(p * c) FILTER (j = 2) / sum(c) FILTER (j = 2) AS a2
        FROM (
            SELECT r.*, p, c, CASE WHEN abs(p - m0) <= abs(p - m1) AND abs(p - m0) <= abs(p - m2) THEN 0 WHEN abs(p - m1) <= abs(p - m2) THEN 1 ELSE 2 END AS j
            FROM r JOIN pts USING (source) WHERE moved AND turn < 50
        ) near GROUP BY ALL
    ) means
),
ends AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY turn DESC) = 1),
placed AS (
    SELECT ends.*, p, c, CASE WHEN abs(p - u0) <= abs(p - u1) AND abs(p - u0) <= abs(p - u2) THEN 0 WHEN abs(p - u1) <= abs(p - u2) THEN 1 ELSE 2 END AS j
    FROM ends JOIN pts USING (source)
)
SELECT source, CAST(j AS BIGINT) AS cluster, CASE j WHEN 0 THEN any_value(m0) WHEN 1 THEN any_value(m1) ELSE any_value(m2) END AS centroid,
       CAST(sum(c) AS BIGINT) AS size
FROM placed GROUP BY source, j
UNION ALL
SELECT source, row_number() OVER (PARTITION BY source ORDER BY price) - 1, CAST(price AS DOUBLE), 1
FROM fact JOIN sizes USING (source) WHERE price > 0 AND n < 3
"""


QUERIES = {
    "fair_values": (fair_values, f"WITH {_FAIR} SELECT {_FAIR_COLS} FROM fair"),
    "fair_values_listing_only": (
        fair_values_listing_only,
        f"WITH {_BUCKETS}{_fair('0.9::DOUBLE', '0.0::DOUBLE', '0.1::DOUBLE').replace('CASE WHEN ebay_median IS NOT NULL THEN 0.0::DOUBLE * ebay_median ELSE 0 END', '0')} SELECT {_FAIR_COLS} FROM fair",
    ),
    "price_buckets": (price_buckets, f"WITH {_BUCKETS} SELECT key, source, count(*) AS n, min(price) AS min_price, max(price) AS max_price FROM buckets GROUP BY key, source"),
    "opportunities": (opportunities, f"WITH {_OPPORTUNITIES}"),
    "backtest": (backtest, f"WITH {_PAIRS} SELECT count(*) AS count, avg(error_pct) AS mape, avg(error_abs) AS mae FROM pairs"),
    "worst_errors": (worst_errors, f"WITH {_PAIRS} SELECT key, console_family, predicted, actual, error_pct, error_abs FROM pairs ORDER BY error_pct DESC, key LIMIT 10"),
    "tune_weights": (tune_weights, f"WITH {_TUNE}"),
    "weights_of_sources": (
        weights_of_sources,
        f"WITH {FACT_SQL} SELECT source, count(*) AS rows, CASE source WHEN 'cex' THEN 2.0::DOUBLE / 3.0 WHEN 'subito' THEN 1.0::DOUBLE / 3.0 ELSE 0.0 END AS weight FROM fact GROUP BY source",
    ),
    "explain_values": (explain_values, f"WITH {_EXPLAIN}"),
    "trimmed_mean": (trimmed_mean, f"WITH {_TRIMMED}"),
    "price_summary": (price_summary, f"WITH {_SUMMARY}"),
    "thresholds": (thresholds, f"WITH {_THRESHOLDS} SELECT console_family, threshold FROM thresholds"),
    "deals": (
        deals,
        f"WITH {_DEALS} SELECT urn_id, console_family, last_price, threshold, row_number() OVER (ORDER BY console_family NULLS FIRST, last_price, {ID_SQL}) <= 50 AS sent, "
        "'€# (soglia €#)' || CASE WHEN size > 10 THEN ' · city' ELSE '' END || ' — ' || name AS message FROM deals",
    ),
    "alert_log": (
        alert_log,
        f"WITH {_DEALS} SELECT urn_id, strftime(ts, '%Y-%m-%d') || 'T00:00:00+00:00' AS ts FROM kept UNION ALL SELECT urn_id, '1996-02-15T00:00:00+00:00' AS ts FROM deals",
    ),
    "z_score": (
        z_score,
        f"WITH {FACT_SQL} SELECT console_family, count(*) AS n, min(price) AS min_price, CASE WHEN count(*) > 2 THEN CASE WHEN stddev_samp(price) = 0 THEN 0 ELSE (min(price) - avg(price)) / stddev_samp(price) END END AS z_score FROM fact WHERE price > 0 GROUP BY 1",
    ),
    "spread": (spread, f"WITH {FACT_SQL} SELECT console_family, min(price) FILTER (source = 'cex') - avg(price) FILTER (source IN ('subito', 'ebay')) AS spread FROM fact GROUP BY 1"),
    "daily_min_price": (daily_min_price, f"WITH {_DAILY} SELECT product_id, strftime(day, '%Y-%m-%d') AS day, price FROM daily"),
    "slope": (slope, f"WITH {_DAILY} SELECT product_id, max(n) AS days, CASE WHEN max(n) >= 2 THEN regr_slope(price, x) END AS slope FROM series GROUP BY product_id"),
    "ema": (ema, f"WITH {_EMA}"),
    "price_trend": (
        price_trend,
        f"WITH {_DAILY} SELECT product_id, count(*) AS days, arg_max(price, day) AS current_price, min(price) AS min_price, max(price) AS max_price FROM daily WHERE day >= DATE '2024-01-10' GROUP BY 1 HAVING count(*) >= 2",
    ),
    "stockout": (stockout, f"WITH {_STOCKOUT}"),
    "availability_transitions": (
        transitions,
        f"WITH {LOG_SQL}, steps AS (SELECT *, lag(available_new) OVER (PARTITION BY product_id ORDER BY changed_at, id) AS before FROM log) SELECT id, product_id, strftime(changed_at, '%Y-%m-%d %H:%M:%S') AS changed_at FROM steps WHERE before = 1 AND available_new = 0",
    ),
    "ci95": (
        ci95,
        f"WITH {FACT_SQL}, g AS (SELECT console_family, count(*) AS n, avg(price) AS mean, 1.96 * stddev_samp(price) / sqrt(count(*)) AS margin FROM fact WHERE price > 0 GROUP BY 1) SELECT console_family, n, mean, margin, mean + margin AS upper, margin / mean > 0.25 AS volatile, greatest(0.0, mean - margin) AS lower FROM g",
    ),
    "premium": (premium, f"WITH {_PREMIUM}"),
    "storage_corr": (storage_corr, f"WITH {FACT_SQL} SELECT console_family, count(DISTINCT size) AS sizes, corr(size, price) AS correlation FROM fact WHERE price > 0 AND size > 0 GROUP BY 1"),
    "feature_value": (
        feature_value,
        f"WITH {FACT_SQL} SELECT console_family, avg(price) FILTER (name LIKE '%red%') - avg(price) FILTER (name NOT LIKE '%red%' AND name LIKE '%blue%') AS feature_value FROM fact WHERE price > 0 GROUP BY 1",
    ),
    "kmeans_1d": (kmeans_1d, f"WITH RECURSIVE {FACT_SQL}, {_KMEANS}"),
    "model_statistics": (model_statistics, f"WITH {_MODEL_STATS}"),
    "family_average": (family_average, f"WITH {ADS_SQL} SELECT console_family, avg(last_price) AS avg_price, count(*) AS ads FROM ads WHERE last_available = 1 AND last_price >= 35000 GROUP BY 1"),
    "deal_bands": (deal_bands, f"WITH {_DEAL_BANDS}"),
    "family_store_matrix": (family_store_matrix, _matrix_sql()),
    "store_card_counts": (
        store_card_counts,
        f"WITH {FACT_SQL} SELECT source, console_family, CAST(grouping(source, console_family) AS BIGINT) AS level, count(*) FILTER (available = 1) AS available, count(*) AS total FROM fact GROUP BY GROUPING SETS ((source, console_family), (source))",
    ),
    "store_stats": (
        store_stats,
        f"WITH {FACT_SQL} SELECT console_family, CAST(grouping(console_family) AS BIGINT) AS level, count(*) AS count, min(price) FILTER (price > 0) AS min_price, max(price) AS max_price, avg(price) FILTER (price > 0) AS avg_price FROM fact WHERE source = 'ebay' GROUP BY ROLLUP (console_family)",
    ),
    "global_counts": (
        global_counts,
        f"WITH {FACT_SQL} SELECT count(*) AS total, count(*) FILTER (available = 1) AS available, count(DISTINCT source) FILTER (source NOT IN ('subito', 'ebay')) AS stores FROM fact",
    ),
}
