"""Deals below the store threshold, and the log of what was already announced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketlens import catalog
from marketlens.functions import scores, times
from marketlens.functions.text import title_case
from marketlens.operators.filters import is_approved


def find_deals(ads: DataFrame, thresholds: DataFrame, notified: DataFrame, approved: Sequence[str] = catalog.APPROVED) -> DataFrame:
    """Available, approved listings below their family's threshold that were not announced yet."""
    family = scores.family_or_other()
    limits = thresholds.select(F.col("console_family").alias("_fam"), "threshold")
    live = ads.where((F.col("last_available") == 1) & is_approved(F.col("ai_status"), approved) & (F.col("last_price") > 0))
    cheap = live.join(limits, family == F.col("_fam")).where(F.col("last_price") < F.col("threshold")).drop("_fam")
    return cheap.join(notified.select("urn_id").distinct(), "urn_id", "left_anti")


def alert_text(deals: DataFrame) -> DataFrame:
    family = scores.family_or_other()
    label = F.coalesce(scores.lookup(catalog.FAMILY_LABELS, family), F.upper(family))
    city = F.when(F.coalesce("city", F.lit("")) != "", F.concat(F.lit(" · "), "city")).otherwise(F.lit(""))
    whole = lambda c: F.bround(c, 0).cast("long").cast("string")
    message = F.concat(
        F.lit("€"), whole("last_price"), F.lit(" (soglia €"), whole("threshold"), F.lit(")"), city, F.lit(" — "), F.substring("name", 1, 60)
    )
    return deals.withColumn("title", F.concat(F.lit("🎮 Deal "), label, F.lit("!"))).withColumn("message", message)


def purge_log(log: DataFrame, as_of: Column, days: int = catalog.ALERT_RETENTION_DAYS) -> DataFrame:
    """Entries with a readable time not older than ``days``."""
    ts = times.to_utc(F.col("ts"))
    oldest = times.micros(as_of) - F.lit(days * 86_400_000_000)
    return log.where(ts.isNotNull() & (times.micros(ts) >= oldest))


def cap_alerts(deals: DataFrame, order: Sequence[Column], cap: int = catalog.ALERT_CAP, key: str = "urn_id") -> DataFrame:
    """Every deal is recorded; ``sent`` marks the first ``cap`` in order."""
    # At most ``cap`` rows, so the join can send them to every task.
    first = deals.orderBy(*order).limit(cap).select(F.col(key).alias("_sent"))
    return deals.join(F.broadcast(first), F.col(key) == F.col("_sent"), "left").withColumn("sent", F.col("_sent").isNotNull()).drop("_sent")


def alert_log(log: DataFrame, deals: DataFrame, as_of: Column, as_of_text: Column) -> DataFrame:
    """The purged log with every new deal stamped ``as_of``."""
    return purge_log(log, as_of).select("urn_id", "ts").unionByName(deals.select("urn_id", as_of_text.alias("ts")))


def check_alerts(
    ads: DataFrame, products_thresholds: DataFrame, log: DataFrame, as_of: Column, as_of_text: Column,
    approved: Sequence[str] = catalog.APPROVED, cap: int = catalog.ALERT_CAP,
) -> tuple[DataFrame, DataFrame]:
    """Announcements (with ``sent``) and the next log."""
    kept = purge_log(log, as_of)
    deals = find_deals(ads, products_thresholds, kept, approved)
    # The order of the listing table decides what is sent when there are more deals than the cap.
    order = [F.col("console_family").asc(), F.col("last_price").asc_nulls_last(), F.col("id").asc()]
    return cap_alerts(alert_text(deals), order, cap), alert_log(log, deals, as_of, as_of_text)


def source_title(source: Column, labels: dict[str, str]) -> Column:
    known = scores.lookup(labels, source) if labels else F.lit(None).cast("string")
    return F.coalesce(known, title_case(source))
