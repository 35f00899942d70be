"""Row filters and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketlens import catalog
from marketlens.functions.scores import lookup
from marketlens.functions.text import blank, has_any, matches
from marketlens.functions.times import within_days
from marketlens.functions.urls import simple_url


def valid_rows(df: DataFrame, required: Sequence[str]) -> DataFrame:
    for name in required:
        df = df.where(~blank(F.col(name)))
    return df


def invalid_rows(df: DataFrame, required: Sequence[str]) -> DataFrame:
    bad = F.lit(False)
    for name in required:
        bad = bad | blank(F.col(name))
    return df.where(bad)


def is_relevant(
    subject: Column, body: Column, token: str = catalog.RELEVANT_TOKEN,
    series: str = catalog.RELEVANT_SERIES, context: str = catalog.RELEVANT_CONTEXT,
) -> Column:
    text = F.concat_ws("\n", F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit("")))
    return matches(text, token) | (matches(text, series) & matches(text, context))


def topic_match(
    name: Column, body: Column, url: Column, any_of: Sequence[str] = catalog.TOPIC_ANY,
    model: Sequence[str] = catalog.TOPIC_MODEL, context: Sequence[str] = catalog.TOPIC_CONTEXT,
) -> Column:
    """Null when null texts leave it open, so that a negation leaves such rows out as well."""
    direct = has_any(name, any_of) | has_any(body, any_of) | has_any(url, any_of)
    modelled = has_any(name, model) | has_any(body, model)
    framed = has_any(name, context) | has_any(body, context)
    return direct | (modelled & framed)


def rejected_listing(
    name: Column, family: Column, price: Column, block: str, allow: str,
    floors: dict[str, float] = catalog.PRICE_FLOORS, default_floor: float = catalog.DEFAULT_FLOOR,
) -> Column:
    """Blocked words, no allowed word, or a price below the family's floor."""
    floor = F.coalesce(lookup(floors, F.coalesce(family, F.lit("other"))), F.lit(default_floor))
    cheap = F.coalesce(price < floor, F.lit(False))
    return matches(name, block) | ~matches(name, allow) | cheap


def is_console_name(name: Column, family: str = catalog.CONSOLE_NAME_FAMILY, hint: str = catalog.CONSOLE_NAME_HINT) -> Column:
    return matches(name, family) & matches(name, hint)


def exclude_parts(df: DataFrame, name: str, pattern: str = catalog.PARTS) -> DataFrame:
    return df.where(~F.coalesce(F.col(name), F.lit("")).rlike("(?i)" + pattern))


def drop_blocked_urls(df: DataFrame, url: str, blocked: Sequence[str] | DataFrame) -> DataFrame:
    """``blocked`` is a short fixed list, or a table with a ``url`` column of any size."""
    key = simple_url(F.col(url))
    if isinstance(blocked, DataFrame):
        listed = blocked.select(simple_url(F.col("url")).alias("_u")).distinct()
        return df.join(listed, key == F.col("_u"), "left_anti")
    return df.where(~key.isin(*[b.lower().rstrip("/") for b in blocked]))


def search(
    df: DataFrame, *, base_family: str | None = None, sub_model: str | None = None,
    edition: str | None = None, color: str | None = None, storage: str | None = None,
    has_kinect: int | None = None, available_only: bool = False,
    groups: dict[str, Sequence[str]] = catalog.FAMILY_GROUPS,
) -> DataFrame:
    tests: list[Column] = []
    if base_family in groups:
        tests.append(F.col("console_family").isin(*groups[base_family]))
    if sub_model:
        tests.append(F.col("sub_model") == sub_model)
    if edition:
        tests.append(F.col("edition_name") == edition)
    if color:
        c = F.col("color")
        tests.append(c.ilike(color) | c.ilike(f"{color}/%") | c.ilike(f"%/{color}"))
    if storage:
        tests.append(F.col("storage_label") == storage)
    if has_kinect is not None:
        tests.append(F.col("has_kinect") == has_kinect)
    if available_only:
        tests.append(F.col("last_available") == 1)
    for t in tests:
        df = df.where(t)
    return df.orderBy("standard_name", "last_price", "id")


def facet_filter(
    df: DataFrame, *, text: str = "", source: str = "", families: Sequence[str] = (),
    conditions: Sequence[str] = (), storage: str = "", segments: Sequence[str] = (),
    edition: str = "", available_only: bool = False, base_only: bool = False,
) -> DataFrame:
    def low(name: str) -> Column:
        return F.lower(F.coalesce(F.col(name), F.lit("")))

    if text:
        needle = F.lit(text.lower().strip())
        df = df.where(F.contains(low("name"), needle) | F.contains(low("standard_name"), needle))
    if source:
        df = df.where(F.col("source") == source)
    if families:
        wanted = F.lit(False)
        for f in families:
            wanted = wanted | F.contains(low("console_family"), F.lit(f.lower()))
        df = df.where(wanted)
    if conditions:
        df = df.where(F.col("condition").isin(*conditions))
    if storage:
        df = df.where(F.col("storage_label") == storage)
    if segments:
        df = df.where(F.col("sub_model").isin(*segments))
    if edition:
        e = F.lit(edition.lower())
        exact = F.lower(F.coalesce(F.col("edition_class"), F.lit("standard"))) == e
        df = df.where(exact | F.contains(low("parsed_edition"), e) | F.contains(low("edition_name"), e))
    if available_only:
        df = df.where(F.col("last_available") == 1)
    if base_only:
        df = df.where(F.col("is_base_model") == 1)
    return df


def is_approved(status: Column, approved: Sequence[str] = catalog.APPROVED) -> Column:
    return F.coalesce(status, F.lit("")).isin(*approved)


def is_pending(status: Column, pending: Sequence[str] = catalog.PENDING) -> Column:
    return F.coalesce(status, F.lit("pending")).isin(*pending)


def is_active(available: Column, sold_at: Column) -> Column:
    return (F.coalesce(available, F.lit(0)) == 1) & sold_at.isNull()


def listing_view(df: DataFrame, mode: str) -> DataFrame:
    """``approved`` and ``pending`` show what is on sale, ``sold`` and ``market`` what was sold."""
    active = lambda: is_active(F.col("last_available"), F.col("sold_at"))
    if mode == "approved":
        return df.where(is_approved(F.col("ai_status")) & active())
    if mode == "pending":
        return df.where(is_pending(F.col("ai_status")) & active())
    if mode == "sold":
        return df.where(F.col("sold_at").isNotNull())
    if mode == "market":
        return exclude_parts(df, "name")
    raise ValueError(f"unknown listing view: {mode}")


def listing_filter(
    df: DataFrame, *, text: str = "", family: str = "", seller: str = "", region: str = "", public_id: Column | None = None
) -> DataFrame:
    if text:
        needle = F.lit(text.lower().strip())
        hit = F.contains(F.lower(F.coalesce(F.col("name"), F.lit(""))), needle)
        if public_id is not None:
            hit = hit | F.contains(F.lower(public_id), needle)
        df = df.where(hit)
    for name, wanted in (("console_family", family), ("seller_type", seller), ("region", region)):
        if wanted:
            df = df.where(F.col(name) == wanted)
    return df


def recent(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    return df.where(within_days(F.col(ts), as_of, days))


def active_ads(df: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    kept = recent(df.where(F.col("last_available") == 1), "last_seen", as_of, days)
    return kept.orderBy("console_family", F.col("last_price").asc_nulls_last(), "id")


def sold_range(df: DataFrame, day: str, days: int | None) -> DataFrame:
    """The last ``days`` days, counted back from the latest day in the data."""
    dated = df.where(F.col(day).isNotNull())
    if days is None:
        return dated
    latest = dated.agg(F.max(day)).scalar()
    return dated.where(F.col(day) >= F.date_sub(latest, days - 1))


def _blank_or_missing(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(F.col(name)) == "")


def needs_rules(df: DataFrame, version: str) -> DataFrame:
    stale = (
        (F.col("console_family") == "other") | (F.col("model_segment") == "unknown")
        | _blank_or_missing("canonical_model") | _blank_or_missing("classify_method")
        | F.col("classify_version").isNull() | (F.trim("classify_version") != version)
    )
    return df.where(stale)


def needs_model(df: DataFrame, prompt_version: str, everything: bool = False) -> DataFrame:
    open_rows = df.where((F.col("last_available") == 1) & F.col("sold_at").isNull())
    if everything:
        return open_rows
    return open_rows.where(
        F.col("ai_status").isin(*catalog.PENDING) | F.col("ai_confidence").isNull()
        | F.col("ai_prompt_version").isNull() | (F.col("ai_prompt_version") != prompt_version)
    )


def needs_model_sold(df: DataFrame, everything: bool = False) -> DataFrame:
    method = F.col("classify_method")
    return df if everything else df.where(method.isNull() | ~method.like("ai-cascade:%"))


def needs_model_legacy(df: DataFrame, sold: bool = False, everything: bool = False) -> DataFrame:
    if everything:
        return df
    if not sold:
        return df.where((F.col("ai_status") == "pending") & F.col("ai_confidence").isNull())
    weak = (
        F.col("canonical_model").isin("other", "unknown") | F.col("canonical_model").isNull()
        | F.col("classify_confidence").isNull() | (F.col("classify_confidence") < 0.6)
    )
    method = F.col("classify_method")
    return df.where(weak & (method.isNull() | ~method.like("ai:%")))


def unsold_active(df: DataFrame, statuses: Sequence[str]) -> DataFrame:
    return df.where(F.col("ai_status").isin(*statuses) & (F.col("last_available") == 1) & F.col("sold_at").isNull())


def recent_errors(df: DataFrame, ts: str, as_of: Column, hours: int) -> DataFrame:
    """All entries of the log younger than ``hours``."""
    return df.where(F.unix_micros(F.col(ts).cast("timestamp")) >= F.unix_micros(as_of.cast("timestamp")) - hours * 3_600_000_000)


def check_constraints(df: DataFrame, non_negative: Sequence[str] = (), flags: Sequence[str] = ()) -> DataFrame:
    """Adds ``violation``: the first broken rule, or null."""
    out = F.lit(None).cast("string")
    for name in reversed(list(flags)):
        out = F.when(F.col(name).isNotNull() & ~F.col(name).isin(0, 1), F.lit(f"{name} not 0/1")).otherwise(out)
    for name in reversed(list(non_negative)):
        out = F.when(F.col(name) < 0, F.lit(f"{name} negative")).otherwise(out)
    return df.withColumn("violation", out)


def split_constraints(df: DataFrame, non_negative: Sequence[str] = (), flags: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    marked = check_constraints(df, non_negative, flags)
    return marked.where(F.col("violation").isNull()).drop("violation"), marked.where(F.col("violation").isNotNull())
