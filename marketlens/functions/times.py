"""Time: tolerant parsing, ages, lifecycle windows, duration texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_HOUR = 3_600_000_000.0


def to_utc(text: Column) -> Column:
    """ISO text to a timestamp; no zone means UTC, blank or malformed text is null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.regexp_replace(t, "Z$", "+00:00")))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def hours_between(end: Column, start: Column) -> Column:
    return (micros(end) - micros(start)) / MICROS_PER_HOUR


def age_hours(ts: Column, as_of: Column) -> Column:
    return F.when(ts.isNotNull(), F.greatest(F.lit(0.0), hours_between(as_of, ts)))


def within_days(ts: Column, as_of: Column, days: int) -> Column:
    """The whole cut-off day counts."""
    return F.to_date(ts) >= F.date_sub(F.to_date(as_of), days)


def midpoint(start: Column, end: Column) -> Column:
    return F.timestamp_micros(micros(start) + F.floor((micros(end) - micros(start)) / 2))


def sold_estimate(last_active: Column, first_inactive: Column) -> Column:
    """Middle of the interval in which the listing ended; the end itself without a usable start."""
    usable = last_active.isNotNull() & (first_inactive >= last_active)
    return F.when(first_inactive.isNull(), F.lit(None).cast("timestamp")).when(
        usable, midpoint(last_active, first_inactive)
    ).otherwise(first_inactive)


def sold_window_hours(last_active: Column, first_inactive: Column) -> Column:
    usable = last_active.isNotNull() & (first_inactive >= last_active)
    return F.when(usable, hours_between(first_inactive, last_active))


def day_period(hour: Column) -> Column:
    return (
        F.when(hour.between(0, 5), "night")
        .when(hour.between(6, 11), "morning")
        .when(hour.between(12, 17), "afternoon")
        .otherwise("evening")
    )


def weekday(ts: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(ts) - 1


def duration_text(hours: Column) -> Column:
    whole = F.bround(hours, 0).cast("long")
    days = F.bround(hours / 24, 0).cast("long")
    return F.when(hours.isNull(), F.lit("—")).when(
        hours < 48, F.concat(whole.cast("string"), F.lit(" ore"))
    ).otherwise(F.concat(days.cast("string"), F.lit(" giorni")))


def sold_day(estimated: Column, sold_at: Column, last_seen: Column) -> Column:
    return F.to_date(F.coalesce(estimated, sold_at, last_seen))


def backoff_seconds(blocks: Column) -> Column:
    grown = F.least(F.lit(300.0), F.lit(30.0) * F.pow(F.lit(2.0), F.least(blocks, F.lit(10)) - 1))
    return F.when(blocks <= 0, F.lit(0)).otherwise(grown.cast("long"))
