"""Web addresses: two normal forms, stable ids, evidence in an address."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marketlens import catalog

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def simple_url(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "/+$", "")


def normalize_url(url: Column) -> Column:
    """Lower scheme and host, sorted query, no fragment; empty stays empty."""
    text = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(text, _PARTS, 1))
    host = F.lower(F.regexp_extract(text, _PARTS, 2))
    path = F.regexp_extract(text, _PARTS, 3)
    query = F.array_join(
        F.sort_array(F.filter(F.split(F.regexp_extract(text, _PARTS, 4), "&"), lambda p: p != "")), "&"
    )
    built = F.concat(
        F.when(scheme == "", F.lit("https")).otherwise(scheme),
        F.when(host == "", F.lit(":")).otherwise(F.concat(F.lit("://"), host)),
        F.when(path == "", F.lit("/")).when((host != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(built)


def stable_item_id(prefix: str, url: Column, length: int = 16) -> Column:
    digest = F.sha1(F.encode(normalize_url(url), "UTF-8"))
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(digest, 1, length)))


def ended_redirect(url: Column) -> Column:
    """The final address shows that the listing is gone."""
    final = F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", "")
    return (final == catalog.SOLD_HOME) | (
        F.contains(final, F.lit("annunci-italia/vendita")) & F.contains(final, F.lit("q="))
    )


def ended_marker(text: Column, markers: tuple[str, ...] = catalog.SOLD_MARKERS) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for marker in markers:
        hit = hit | F.contains(low, F.lit(marker))
    return hit


def condition_from_url(url: Column) -> Column:
    low = F.lower(url)
    used = F.contains(low, F.lit("condizioni-usato")) | F.contains(low, F.lit("-usato-")) | low.endswith("-usato")
    return F.when(used, F.lit("Usato")).otherwise(F.lit("Nuovo"))


def condition_from_markers(name: Column, url: Column, pattern: str = catalog.USED_MARKER) -> Column:
    rx = "(?iU)" + pattern
    used = F.coalesce(name, F.lit("")).rlike(rx) | F.coalesce(url, F.lit("")).rlike(rx)
    return F.when(used, F.lit("Usato")).otherwise(F.lit("Nuovo"))
