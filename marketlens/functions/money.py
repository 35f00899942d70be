"""Prices: parsing, formatting, rounding, storage sizes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean_price(text: Column) -> Column:
    """Number in a price text. Dot and comma together: the dot groups thousands."""
    bare = F.regexp_replace(text, r"(?U)[€$£\s]", "")
    both = F.contains(bare, F.lit(".")) & F.contains(bare, F.lit(","))
    plain = F.when(both, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(
        F.replace(bare, F.lit(","), F.lit("."))
    )
    return F.regexp_replace(plain, r"[^0-9.]", "").try_cast("double")


def parse_price_eur(text: Column) -> Column:
    """First number of the text, read with Italian grouping when it has that form."""
    bare = F.regexp_replace(F.replace(text, F.lit("EUR"), F.lit("")), " ", " ")
    number = F.regexp_extract(bare, r"([\d.,]+)", 1)
    dotless = F.replace(F.replace(number, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return (
        F.when(number.rlike(r"^\d{1,3}(\.\d{3})*(,\d{1,2})?$"), dotless)
        .when(number.rlike(r"^\d+(,\d{1,2})?$"), F.replace(number, F.lit(","), F.lit(".")))
        .otherwise(number)
        .try_cast("double")
    )


def format_price_it(price: Column) -> Column:
    shown = F.replace(F.format_string("%.2f", F.bround(price, 2)), F.lit("."), F.lit(","))
    return F.when(price.isNull(), F.lit("N/D")).otherwise(F.concat(shown, F.lit(" €")))


def storage_label(name: Column) -> Column:
    """'1TB' becomes '1 TB'; null when the name has no size."""
    pattern = r"(?iU)(\d[\d.]*)\s*(GB|TB)"
    value = F.replace(F.regexp_extract(name, pattern, 1), F.lit("."), F.lit(""))
    unit = F.upper(F.regexp_extract(name, pattern, 2))
    return F.when(value != "", F.concat(value, F.lit(" "), unit))


def storage_gb(text: Column, pattern: str, tb_factor: int = 1024) -> Column:
    value = F.replace(F.regexp_extract(text, "(?iU)" + pattern, 1), F.lit("."), F.lit("")).try_cast("long")
    unit = F.upper(F.regexp_extract(text, "(?iU)" + pattern, 2))
    return F.when(unit.isin("TB", "T"), value * tb_factor).otherwise(value)


def title_memory(title: Column, patterns: dict[str, str], tb_factor: int = 1024) -> Column:
    """Memory named in a title, in GB; a 256 MB unit counts as a quarter."""
    return F.when(title.rlike("(?iU)" + patterns["storage_mb"]), F.lit(0.25)).otherwise(
        storage_gb(title, patterns["storage"], tb_factor).cast("double")
    )


def memory_gb(memory: Column, tb_factor: int = 1024) -> Column:
    compact = F.replace(F.upper(F.trim(memory)), F.lit(" "), F.lit(""))
    value = F.regexp_extract(compact, r"^(\d+)(MB|GB|TB|T)$", 1).try_cast("double")
    unit = F.regexp_extract(compact, r"^(\d+)(MB|GB|TB|T)$", 2)
    return (
        F.when(unit == "MB", F.round(value / 1024, 4))
        .when(unit == "GB", value)
        .when(unit.isin("TB", "T"), value * tb_factor)
    )


def label_gb(label: Column, tb_factor: int = 1024) -> Column:
    """Size of a storage label; 0 when it names none."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    tb = F.regexp_extract(low, r"(\d+(\.\d+)?)\s*tb", 1).try_cast("double")
    gb = F.regexp_extract(low, r"(\d+(\.\d+)?)\s*gb", 1).try_cast("double")
    return F.coalesce(tb * tb_factor, gb, F.lit(0.0))


def positive(price: Column) -> Column:
    return F.when(price > 0, price)
