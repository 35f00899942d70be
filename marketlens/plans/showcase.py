"""Parsed view of products, comparable combos, and the grid of models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketlens import catalog
from marketlens.functions import money
from marketlens.functions.scores import lookup
from marketlens.functions.titles import detect_family
from marketlens.operators import joins, windows
from marketlens.operators.filters import is_approved


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def _segment(text: Column, family: Column, given: Column) -> Column:
    out = None
    for key, rules in catalog.VIEW_SEGMENTS.items():
        value = None
        for label, pattern in rules:
            value = F.when(_has(text, pattern), label) if value is None else value.when(_has(text, pattern), label)
        value = value.otherwise("Unknown" if key == "series" else "Base")
        out = F.when(family == key, value) if out is None else out.when(family == key, value)
    found = out.otherwise("Base")
    return F.coalesce(F.when(given == "Slim", "S").otherwise(F.when(given != "", given)), found)


def view_colors(text: Column) -> Column:
    switches = {k: _has(text, p) for k, p in catalog.VIEW_SWITCHES.items()}
    hits = []
    for label, pattern, off in catalog.VIEW_COLORS:
        test = _has(text, pattern)
        for s in off:
            test = test & ~switches[s]
        hits.append(F.when(test, F.lit(label)))
    return F.array_compact(F.array(*hits))


def view_edition(text: Column) -> Column:
    out = None
    for label, pattern in catalog.VIEW_EDITIONS:
        out = F.when(_has(text, pattern), label) if out is None else out.when(_has(text, pattern), label)
    bundle = _has(text, catalog.VIEW_BUNDLE) & ~F.contains(text, F.lit("controller"))
    return out.when(bundle, "Bundle")


def parsed_view(products: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Adds the parsed family, segment, edition, colour, Kinect flag, storage and ``combo_key``.

    Columns that are absent count as null; manual overrides win over what the name says.
    """
    needed = {
        "display_id": ("long", None), "console_family": ("string", None), "sub_model": ("string", None), "storage_label": ("string", None),
        "edition_class": ("string", None), "condition": ("string", None), "seller_type": ("string", None), "packaging_state": ("string", None),
    }
    df = products
    for name, (kind, default) in needed.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(kind))
    if overrides is not None:
        df = joins.apply_overrides(df, overrides)
    else:
        df = df.withColumn("fixed_color", F.lit(None).cast("string")).withColumn("fixed_edition", F.lit(None).cast("string"))
    text = F.lower(F.coalesce("name", F.lit("")))
    raw = F.coalesce(F.when(F.col("console_family") != "", F.col("console_family")), detect_family(F.col("name")))
    alias = {"series-x": "series", "series-s": "series", "one-x": "one", "one-s": "one"}
    family = F.coalesce(lookup(alias, F.lower(F.trim(raw))), F.lower(F.trim(raw)))
    by_alias = F.when(raw.isin("series-x", "one-x"), "X").when(raw.isin("series-s", "one-s"), "S")
    df = df.withColumn("_fk", family).withColumn("_given", F.coalesce(F.when(F.col("sub_model") != "", F.col("sub_model")), by_alias))
    shades = view_colors(text)
    shades = F.when(
        F.col("fixed_color").isNotNull() & ~F.array_contains(shades, F.col("fixed_color")), F.array_append(shades, F.col("fixed_color"))
    ).otherwise(shades)
    df = df.withColumn("_colors", F.array_join(shades, ", "))
    edition = F.coalesce("fixed_edition", view_edition(text), F.when(F.col("edition_class") != "", F.col("edition_class")), F.lit("standard"))
    edition = F.concat(F.upper(F.substring(edition, 1, 1)), F.substring(edition, 2, 1 << 30))
    kinect = _has(text, r"\bkinect\b") & ~_has(text, r"\b(?:no|senza)\s+kinect\b|\(no\s+kinect\)")
    named = F.coalesce(*[
        F.when(F.regexp_extract(text, rf"(\d+(?:[.,]\d+)?)\s*{u.lower()}", 1) != "", F.concat(F.replace(F.regexp_extract(text, rf"(\d+(?:[.,]\d+)?)\s*{u.lower()}", 1), F.lit(","), F.lit(".")), F.lit(f" {u}")))
        for u in ("TB", "GB")
    ])
    out = (
        df.withColumn("parsed_family", F.coalesce(lookup(catalog.VIEW_FAMILY, F.col("_fk")), F.lit("Altro")))
        .withColumn("parsed_segment", _segment(text, F.col("_fk"), F.col("_given")))
        .withColumn("parsed_kinect", kinect)
        .withColumn("parsed_color", F.col("_colors"))
        .withColumn("parsed_edition", F.coalesce("fixed_edition", F.when(F.col("_colors") != "", F.col("_colors")), edition))
        .withColumn("storage_label", F.coalesce(F.when(F.col("storage_label") != "", F.col("storage_label")), named))
        .withColumn("console_family", F.col("_fk"))
    )
    condition = F.coalesce(F.when(F.col("condition") != "", F.col("condition")), F.when(F.coalesce("seller_type", F.lit("")) != "", "Usato"), F.lit("—"))
    return out.withColumn(
        "combo_key",
        F.concat_ws(
            "|", "parsed_family", "parsed_segment", "parsed_edition", F.col("parsed_kinect").cast("string"), F.coalesce("storage_label", F.lit("—")),
            condition, F.coalesce(F.when(F.col("packaging_state") != "", F.col("packaging_state")), F.lit("Imballata")),
        ),
    ).drop("_fk", "_given", "_colors", "fixed_color", "fixed_edition")


def offer_pool(base: DataFrame, catalogue: DataFrame, snapshot: DataFrame, ads: DataFrame) -> DataFrame:
    """All offers that can be compared, one per address: favourites first, then catalogue,
    snapshot and approved listings."""
    approved = ads.where(is_approved(F.col("ai_status"))).withColumn("source", F.lit("subito")).withColumn("condition", F.lit("Usato")).withColumn(
        "price", F.col("last_price")
    ).withColumn("available", F.col("last_available"))
    return unique_urls(windows.pool([base, catalogue, snapshot, approved]))


def unique_urls(pooled: DataFrame, order: Sequence[str] = ("pool_rank", "id")) -> DataFrame:
    has_url = F.coalesce("url", F.lit("")) != ""
    return pooled.where(~has_url).unionByName(joins.first_per_key(pooled.where(has_url), ["url"], order))


def combo_items(pooled: DataFrame, favourites: DataFrame, invert: bool = False, order: str = "id") -> DataFrame:
    """Items of the favourite combos, or of all others; of the variant source only the dearest item."""
    wanted = favourites.select("combo_key").distinct()
    picked = pooled.join(wanted, "combo_key", "left_anti" if invert else "left_semi")
    return windows.keep_max_per_source(picked, "combo_key", order=order)


def combo_groups(items: DataFrame) -> DataFrame:
    return items.groupBy("combo_key").agg(
        F.count("*").alias("count"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.min_by(F.struct("parsed_family", "parsed_segment", "storage_label"), F.struct("pool_rank", "id")).alias("_r"),
    ).select("combo_key", "count", "min_price", "max_price", "_r.parsed_family", "_r.parsed_segment", "_r.storage_label")


def model_grid(items: DataFrame, stores: Sequence[str] = catalog.STORE_SOURCES) -> DataFrame:
    """Per model: combos with store stock and in total, store price range, store offers in stock."""
    in_store = F.col("source").isin(*stores)
    live = in_store & (F.col("available") == 1)
    combos = items.groupBy("combo_key").agg(
        F.min_by(F.struct("parsed_family", "parsed_segment"), F.struct("pool_rank", "id")).alias("_m"),
        F.coalesce(F.bool_or(live), F.lit(False)).alias("_live"), F.sum(live.cast("long")).alias("_offers"),
        F.min(F.when(in_store, F.col("price"))).alias("_lo"), F.max(F.when(in_store, F.col("price"))).alias("_hi"),
    )
    return combos.groupBy(F.col("_m.parsed_family").alias("family"), F.col("_m.parsed_segment").alias("segment")).agg(
        F.sum(F.col("_live").cast("long")).alias("combos_available"), F.count("*").alias("combos_total"),
        F.min("_lo").alias("min_price"), F.max("_hi").alias("max_price"), F.sum("_offers").alias("offers_available"),
    )


def order_grid(grid: DataFrame, families=("Serie", "One", "360", "Original", "Altro"), segments=("Base", "S", "X", "E", "Elite", "Slim", "Unknown")) -> DataFrame:
    ranked = windows.by_rank(windows.by_rank(grid, "family", families, "_f"), "segment", segments, "_s")
    return ranked.orderBy("_f", "_s", "family", "segment").drop("_f", "_s")


def order_combos(combos: DataFrame, title: str = "title") -> DataFrame:
    """Condition first (new, then used), then title, larger storage first."""
    ranked = windows.by_rank(combos, "condition", ("Nuovo", "Usato"), "_c", 2)
    return ranked.withColumn("_gb", money.label_gb(F.col("storage_label"))).orderBy("_c", title, F.col("_gb").desc(), "combo_key").drop("_c", "_gb")
