"""Which listings to re-check, what a check found, and what that does to their state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketlens import catalog
from marketlens.functions import times, urls
from marketlens.operators import windows
from marketlens.operators.filters import topic_match, unsold_active

BLOCK_RATIO = 0.85
PARTIAL_RATIO = 0.50


def select_for_verification(
    ads: DataFrame, as_of: Column, *, statuses: Sequence[str] = (*catalog.APPROVED, *catalog.PENDING), tiered: bool = True,
    staleness_hours: int = 24, sample_ratio: float = 0.30, seed: int = 0, recheck_days: int | None = None, topic_only: bool = True,
    on_topic: Column | None = None,
) -> DataFrame:
    """Listings to verify, with ``tier``: 1 stale or pending, 2 a share of the fresh, 3 recent sales.

    The share is taken in a repeatable order, so the same input gives the same choice.
    """
    topic = on_topic if on_topic is not None else topic_match(F.col("name"), F.col("body_text"), F.col("url"))
    rows = ads.where(topic) if topic_only else ads
    open_rows = unsold_active(rows, statuses)
    if tiered:
        cutoff = times.micros(as_of) - F.lit(staleness_hours * 3_600_000_000)
        checked = times.micros(F.col("last_verified_at"))
        # Pending rows that were checked lately belong to both tiers, as in a union of two queries.
        stale = (F.coalesce("verify_status", F.lit("")) == "pending") | checked.isNull() | (checked < cutoff)
        tiers = [
            open_rows.where(stale).withColumn("tier", F.lit(1)),
            windows.sample_share(open_rows.where(checked >= cutoff), sample_ratio, seed).withColumn("tier", F.lit(2)),
        ]
    else:
        tiers = [open_rows.withColumn("tier", F.lit(1))]
    if recheck_days:
        oldest = times.micros(as_of) - F.lit(recheck_days * 86_400_000_000)
        sold = rows.where(F.col("ai_status").isin(*statuses) & F.col("sold_at").isNotNull() & (times.micros(F.col("sold_at")) >= oldest))
        tiers.append(sold.withColumn("tier", F.lit(3)))
    out = tiers[0]
    for t in tiers[1:]:
        out = out.unionByName(t)
    return out.orderBy("tier", *windows.verification_order())


def excluded_sample(ads: DataFrame, statuses: Sequence[str], on_topic: Column, limit: int) -> DataFrame:
    """Newest listings that the topic filter leaves out."""
    return unsold_active(ads, statuses).where(~on_topic).orderBy(F.coalesce("last_seen", "first_seen").desc_nulls_last(), "id").limit(limit)


def precheck(status: Column, final_url: Column) -> Column:
    """Light request: ``sold``, ``active`` or ``unknown``."""
    return (
        F.when(status.isin(404, 410), "sold")
        .when(status == 200, F.when(urls.ended_redirect(final_url), "sold").otherwise("active"))
        .otherwise("unknown")
    )


def failure_reason(error: Column) -> Column:
    low = F.lower(error)
    has = lambda *needles: _any(low, needles)
    return (
        F.when(has("err_connection_timed_out", "timeout", "timed out"), "blocked:timeout")
        .when(has("err_name_not_resolved", "err_connection_reset", "err_network_changed", "chrome-error", "interrupted by another navigation"), "blocked:network")
        .otherwise("blocked:error")
    )


def _any(text: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def page_reason(status: Column, final_url: Column, body: Column, error: Column) -> Column:
    """Full page check: why the listing counts as sold, active or blocked."""
    return (
        F.when(error.isNotNull(), failure_reason(error))
        .when(status.isNull(), "blocked:no-response")
        .when(urls.ended_redirect(final_url), "sold:redirect")
        .when(status.isin(404, 410), "sold:http-status")
        .when(status.isin(403, 429, 500, 502, 503, 504), F.concat(F.lit("blocked:http-"), status.cast("string")))
        .when(urls.ended_marker(body), "sold:dom-marker")
        .otherwise("active:dom-ok")
    )


def classify_outcomes(fetches: DataFrame, block_ratio: float = BLOCK_RATIO, partial_ratio: float = PARTIAL_RATIO) -> DataFrame:
    """Adds ``outcome`` (sold, active, pending) and ``reason`` to a fetch log.

    ``fetches`` has id, chunk, pre_status, pre_url and the page check's page_status, page_url,
    page_body, page_error and page_tried. A chunk whose light requests mostly failed is taken
    for blocked: above ``block_ratio`` everything not sold waits, above ``partial_ratio`` only
    the unknown rows do.
    """
    rows = fetches.withColumn("_pre", precheck(F.col("pre_status"), F.col("pre_url")))
    share = rows.groupBy("chunk").agg(F.avg((F.col("_pre") == "unknown").cast("int")).alias("_unknown_share"))
    joined = rows.join(share, "chunk")
    blocked = F.col("_unknown_share") >= block_ratio
    partial = ~blocked & (F.col("_unknown_share") >= partial_ratio)
    page = page_reason(F.col("page_status"), F.col("page_url"), F.col("page_body"), F.col("page_error"))
    reason = (
        F.when(F.col("_pre") == "sold", "sold:precheck")
        .when(blocked, "skipped:cffi-block")
        .when(F.col("_pre") == "active", "active:cffi-200")
        .when(partial, "skipped:cffi-partial")
        .when(~F.coalesce("page_tried", F.lit(True)), "skipped:deadline")
        .otherwise(page)
    )
    outcome = F.when(F.col("reason").startswith("sold:"), "sold").when(F.col("reason").startswith("active:"), "active").otherwise("pending")
    return joined.withColumn("reason", reason).withColumn("outcome", outcome).drop("_pre", "_unknown_share")


def apply_verification(ads: DataFrame, outcomes: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State after verification, change rows, and one row per outcome for the summary.

    ``outcomes`` holds one row per listing: id, outcome, reason, chunk.
    """
    side = outcomes.select(F.col("id").alias("_oid"), "outcome", "reason", "chunk")
    joined = ads.join(side, ads["id"] == F.col("_oid"), "left")
    active, sold, waits = (F.col("outcome") == "active"), (F.col("outcome") == "sold"), (F.col("outcome") == "pending")
    was_live = F.coalesce("last_available", F.lit(0)) == 1
    none_ts = F.lit(None).cast("timestamp")
    inactive = F.coalesce("first_inactive_seen", as_of)
    sold_at = F.coalesce("sold_at", as_of)
    start = F.coalesce("last_active_seen", "last_seen")
    estimate = F.coalesce("sold_at_estimated", times.sold_estimate(start, inactive), sold_at)
    window = F.when(F.col("sold_at_estimated").isNotNull(), F.col("sold_window_hours")).otherwise(times.sold_window_hours(start, inactive))

    def step(column: str, if_active: Column, if_sold: Column) -> Column:
        return F.when(active, if_active).when(sold, if_sold).otherwise(F.col(column)).alias(column)

    changed = {
        "last_seen": step("last_seen", as_of, as_of),
        "last_available": step("last_available", F.lit(1), F.lit(0)),
        "last_active_seen": step("last_active_seen", as_of, F.col("last_active_seen")),
        "first_inactive_seen": step("first_inactive_seen", none_ts, inactive),
        "sold_at": step("sold_at", none_ts, sold_at),
        "sold_at_estimated": step("sold_at_estimated", none_ts, estimate),
        "sold_window_hours": step("sold_window_hours", F.lit(None).cast("double"), window),
        "verify_status": F.when(active, "buyable").when(sold, "sold").when(waits, "pending").otherwise(F.col("verify_status")).alias("verify_status"),
        "last_verified_at": step("last_verified_at", as_of, as_of),
    }
    state = joined.select(*[changed.get(c, F.col(c)) for c in ads.columns])
    log = joined.where(sold & was_live).select(
        F.col("id").alias("ad_id"), as_of.alias("changed_at"), F.col("last_price").alias("price_old"), F.col("last_price").alias("price_new"),
        F.lit(1).alias("available_old"), F.lit(0).alias("available_new"), F.lit("availability").alias("change_type"),
    )
    detail = joined.where(F.col("outcome").isNotNull()).select(
        "id", "chunk", "outcome", "reason", F.col("last_price").alias("price"), (sold & was_live).alias("new_sale"),
        (active & ~was_live).alias("recovered"), F.when(sold & was_live, times.hours_between(estimate, F.col("first_seen"))).alias("hours_active"),
    )
    return state, log, detail
