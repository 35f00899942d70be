"""Scores, bands and status rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marketlens import catalog
from marketlens.functions.text import matches


def family_or_other(family: str = "console_family") -> Column:
    """The family; ``other`` where it is null or blank."""
    return F.when(F.trim(F.coalesce(F.col(family), F.lit(""))) == "", F.lit("other")).otherwise(F.col(family))


def _lookup(values: dict, key: Column) -> Column:
    """Value of a fixed table, as a chain of conditions."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


lookup = _lookup


def model_key(canonical: Column, family: Column) -> Column:
    """The canonical model, or the family when the model is empty or unknown."""
    c = F.trim(F.coalesce(canonical, F.lit("")))
    f = F.trim(F.coalesce(family, F.lit("other")))
    fallback = F.concat(F.lit("family:"), F.when(f == "", F.lit("other")).otherwise(f))
    return F.when((c != "") & (c != "unknown"), c).otherwise(fallback)


def resolve_weights(weights: dict[str, float] | None = None, include_ebay: bool = True) -> dict[str, float]:
    """Weights of the three price sources, made to sum to one."""
    chosen = dict(catalog.SOURCE_WEIGHTS)
    for source, value in (weights or {}).items():
        if source in chosen and isinstance(value, (int, float)):
            chosen[source] = max(0.0, float(value))
    if not include_ebay:
        chosen["ebay"] = 0.0
    total = sum(chosen.values())
    if total > 0:
        return {s: v / total for s, v in chosen.items()}
    return {"cex": 0.5, "ebay": 0.25, "subito": 0.25} if include_ebay else {"cex": 0.5, "ebay": 0.0, "subito": 0.5}


def value_confidence(sources: Column, samples: Column) -> Column:
    raw = F.lit(0.3) + F.lit(0.18) * sources + F.least(samples, F.lit(60)) * F.lit(0.006)
    return F.greatest(F.lit(0.0), F.least(raw, F.lit(1.0)))


def listing_quality(
    price: Column, fair_value: Column, *, has_image: Column, has_city: Column, has_region: Column,
    professional: Column, plain_model: Column, unknown_family: Column,
) -> Column:
    def points(flag: Column, value: float) -> Column:
        return F.when(flag, F.lit(value)).otherwise(F.lit(0.0))

    raw = (
        F.lit(45.0) + points(has_image, 12.0) + points(has_city, 5.0) + points(has_region, 4.0)
        + points(professional, 6.0) + points(plain_model, 8.0)
        - points(price < fair_value * 0.45, 18.0) - points(unknown_family, 14.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def delta_pct(price: Column, fair_value: Column) -> Column:
    return F.when(fair_value > 0, (fair_value - price) / fair_value * 100).otherwise(F.lit(0.0))


def opportunity(delta: Column, quality: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), delta * 0.7 + quality * 0.3))


def band_of_delta(delta: Column) -> Column:
    return (
        F.when(delta >= 30, "fire").when(delta >= 20, "great").when(delta >= 10, "ok")
        .when(delta <= -15, "over").otherwise("none")
    )


def deal_band(price: Column, average: Column) -> Column:
    """Band against the family average; more than 60% below is taken for another kind of item."""
    delta = (average - price) / average * 100
    known = (price > 0) & (average > 0) & (delta <= 60)
    return F.when(known, band_of_delta(delta)).otherwise("none")


def quality_band(quality: Column) -> Column:
    return F.when(quality >= 75, "high").when(quality >= 55, "medium").otherwise("low")


def price_family(family: Column, model: Column) -> Column:
    """Price family of a catalogue row, from its family and model."""
    f, m = F.lower(family), F.lower(model)
    return (
        F.when(f.isin("serie", "series"), F.when(m == "x", "series-x").otherwise("series-s"))
        .when(f == "one", F.when(m == "x", "one-x").when(m == "s", "one-s").otherwise("one-base"))
        .when(f == "360", "360")
        .when(f.isin("original/og", "original", "og"), "original")
        .otherwise("other")
    )


def price_conflict(price: Column, low: Column, high: Column, signal: Column) -> Column:
    known = low.isNotNull() & price.isNotNull()
    odd = (price < low) | (price > high) | signal.isin("suspicious_low", "suspicious_high")
    return F.coalesce(known & odd, F.lit(False))


def final_status(taxonomy_id: Column, confidence: Column, threshold: int, conflict: Column) -> Column:
    return (
        F.when((confidence < threshold) | conflict, "pending_review")
        .when(taxonomy_id == "other", "rejected_auto")
        .otherwise("approved_auto")
    )


def legacy_status(confidence: Column) -> Column:
    return F.when(confidence >= 75, "approved").when(confidence <= 25, "rejected").otherwise("pending")


def one_of(value: Column, allowed, otherwise: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(otherwise))


def packaging_state(source: Column, name: Column, grade: Column) -> Column:
    text = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(grade, F.lit("")))
    return (
        F.when(F.lower(F.trim(F.coalesce(source, F.lit("")))) != "cex", "Imballata")
        .when(matches(text, catalog.PACK_NOT), "Non Imballata")
        .when(matches(text, catalog.PACK_DISCOUNTED), "Scontata")
        .otherwise("Imballata")
    )


def availability_label(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda needle: F.contains(low, F.lit(needle))
    return (
        F.when(has("disponib") & ~has("non"), "Disponibile")
        .when(has("ordinab") | has("prenotab"), "Ordinabile")
        .when(has("esaur"), "Esaurito")
        .when(F.coalesce(text, F.lit("")) != "", text)
        .otherwise("N/D")
    )


def counts_text(counts: Column) -> Column:
    """JSON object of counters to 'k=v, k=v'."""
    parsed = F.from_json(counts, "map<string,string>")
    joined = F.array_join(
        F.transform(F.map_entries(parsed), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "
    )
    return F.substring(joined, 1, 200)


def unstable_reason(reason: Column) -> Column:
    return reason.startswith("blocked:") | F.contains(reason, F.lit("http-403")) | F.contains(
        reason, F.lit("http-429")
    ) | (reason == "skipped:cffi-block")
