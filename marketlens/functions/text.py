"""Column expressions over text: normalising, hashing, tokens, cleaning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from marketlens import catalog

# Accents a listing title can carry, and the plain letter each one stands for (fixed values).
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def ci(pattern: str) -> str:
    """Case-insensitive pattern whose character classes cover all of Unicode."""
    return "(?iU)" + pattern


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(ci(pattern))


def first_pos(text: Column, pattern: str) -> Column:
    """1-based position of the first match, 0 when there is none."""
    return F.regexp_instr(text, F.lit(ci(pattern)))


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def none_if_blank(text: Column) -> Column:
    return F.when(~blank(text), text)


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def shorten(text: Column, limit: int) -> Column:
    value = squeeze(text)
    return F.when(F.length(value) <= limit, value).otherwise(
        F.concat(F.substring(value, 1, limit - 1), F.lit("…"))
    )


def text_hash(name: Column, body: Column) -> Column:
    lowered = F.concat(
        F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit("\n"), F.lower(squeeze(body))
    )
    return F.sha1(F.encode(lowered, "UTF-8"))


def input_hash(name: Column, body: Column, price: Column, prompt: str, taxonomy: str) -> Column:
    payload = F.to_json(
        F.struct(
            F.lower(squeeze(body)).alias("body"),
            price.alias("price"),
            F.lit(prompt).alias("prompt_version"),
            F.lit(taxonomy).alias("taxonomy_version"),
            F.lower(squeeze(name)).alias("title"),
        ),
        {"ignoreNullFields": "false"},
    )
    return F.sha2(payload, 256)


def tokens(text: Column, stop: Iterable[str] = catalog.STOP_TOKENS, min_len: int = 3) -> Column:
    """Distinct lower-case alphanumeric words, short words and stop words left out."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    kept = F.filter(words, lambda w: F.length(w) >= min_len)
    return F.array_except(F.array_distinct(kept), F.array(*[F.lit(s) for s in stop]))


def jaccard(left: Column, right: Column) -> Column:
    union = F.size(F.array_union(left, right))
    shared = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(shared / union)


def region_token(text: Column) -> Column:
    """Accent-free slug used to compare region names."""
    lowered = F.translate(F.lower(F.trim(F.coalesce(text, F.lit("")))), _ACCENTED, _PLAIN)
    return trim_dashes(F.regexp_replace(lowered, "[^a-z0-9]+", "-"))


def trim_dashes(text: Column) -> Column:
    return F.regexp_replace(text, "^-+|-+$", "")


def slug(text: Column, limit: int | None = None) -> Column:
    """Lower-case words joined by dashes, whole unless a ``limit`` is given for display."""
    base = trim_dashes(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"))
    cut = base if limit is None else F.substring(base, 1, limit)
    return F.when(cut == "", F.lit("unknown")).otherwise(cut)


def title_case(text: Column) -> Column:
    """A capital after every non-letter, not only after a space."""
    runs = F.split(text, r"(?<=\P{L})(?=\p{L})")
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30))),
        ),
        "",
    )


def plain_words(text: Column) -> Column:
    """Lower-case ASCII letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def sanitize_text(text: Column) -> Column:
    no_markup = F.regexp_replace(text, "[<>\"'`]", " ")
    no_control = F.regexp_replace(no_markup, "[\\x00-\\x1F\\x7F]", " ")
    return F.trim(F.regexp_replace(F.coalesce(no_control, F.lit("")), r"(?U)\s{2,}", " "))


def sanitize_url(text: Column) -> Column:
    clean = sanitize_text(text)
    return F.when(clean.rlike("(?i)^https?://"), clean).otherwise(F.lit(""))


def sanitize_value(value: Column, kind: DataType, name: str = "") -> Column:
    """Cleans every text inside a value of type ``kind``, however deep it lies, in one expression.

    A text named after an address (field or map key) keeps only web addresses; items of a list
    have no name. Field names, map keys, nulls and values of other types stay as they are.
    """
    if isinstance(kind, StringType):
        clean = sanitize_url if "url" in name.lower() else sanitize_text
        return F.when(value.isNotNull(), clean(value))
    if isinstance(kind, StructType):
        fields = [sanitize_value(value.getField(f.name), f.dataType, f.name).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda item: sanitize_value(item, kind.elementType))
    if isinstance(kind, MapType):
        plain = lambda v: sanitize_value(v, kind.valueType)
        if not (isinstance(kind.keyType, StringType) and isinstance(kind.valueType, StringType)):
            return F.transform_values(value, lambda _, v: plain(v))
        named = lambda k, v: F.when(F.lower(k).contains("url"), sanitize_value(v, kind.valueType, "url")).otherwise(plain(v))
        return F.transform_values(value, named)
    return value


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Every column through :func:`sanitize_value`: nested records, lists of records and maps too."""
    column = lambda name: df["`" + name.replace("`", "``") + "`"]
    return df.select(*[sanitize_value(column(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def redact(text: Column, secrets: Iterable[str] = catalog.SECRETS) -> Column:
    for pattern in secrets:
        text = F.regexp_replace(text, pattern, "***")
    return text


def trailing_id(text: Column) -> Column:
    """Trailing run of five or more digits, else the text itself."""
    digits = F.regexp_extract(text, r"(\d{5,})$", 1)
    return F.when(digits != "", digits).otherwise(text)


def has_any(text: Column, needles: Iterable[str]) -> Column:
    """Null text gives null, as SQL LIKE does."""
    lowered = F.lower(text)
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(lowered, F.lit(needle))
    return hit
