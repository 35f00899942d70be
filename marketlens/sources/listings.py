"""Raw listing records to flat offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from marketlens import catalog
from marketlens.functions.money import clean_price, format_price_it, parse_price_eur
from marketlens.functions.scores import lookup
from marketlens.functions.text import matches
from marketlens.functions.urls import stable_item_id
from marketlens.operators.filters import is_relevant

_KEYED = "struct<key:string,value:string>"
LISTING_SCHEMA = (
    "struct<subject:string,body:string,urls:struct<`default`:string>,urn:string,date:string,"
    f"features:map<string,struct<values:array<{_KEYED}>>>,"
    "geo:struct<town:struct<value:string>,region:struct<value:string>>,"
    "images:array<struct<cdnBaseUrl:string>>,advertiser:struct<company:boolean>,type:struct<key:string>>"
)


def flatten_listing_json(df: DataFrame, json: str = "json", strict: bool = True, source: str = "subito", prefix: str = "SUBITO") -> DataFrame:
    """Nested listing JSON to offers; rows without a subject, or off topic when ``strict``, drop out."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    # Exploded from an array of one, so that filters and fields share a single parse.
    d = df.withColumn("_d", F.explode(F.array(F.from_json(json, LISTING_SCHEMA))))
    subject, body = text(F.col("_d.subject")), text(F.col("_d.body"))
    url = F.coalesce("_d.urls.default", F.lit(""))
    listed = F.regexp_extract(F.coalesce("_d.urn", F.lit("")), r":list:(\d+)$", 1)

    def feature(name: str) -> Column:
        return F.get(F.col("_d.features")[name]["values"], 0)

    price = clean_price(feature("/price")["key"])
    haggled = feature("/price").isNotNull() & (price <= 0)
    code = feature("/item_condition")
    out = d.select(
        *[c for c in df.columns if c != json],
        subject.alias("name"), body.alias("body_text"),
        F.when(listed != "", F.concat(F.lit(prefix + "-"), listed)).otherwise(stable_item_id(prefix, url)).alias("sku"),
        F.when(price > 0, price).alias("price"),
        F.when(haggled, "Trattabile").otherwise(F.coalesce(feature("/price")["value"], feature("/price")["key"], F.lit("N/D"))).alias("price_display"),
        F.when(code.isNull(), "N/D").otherwise(F.coalesce(lookup(catalog.CONDITION_CODES, code["key"]), F.lit("Usato"))).alias("condition"),
        (F.coalesce("_d.type.key", F.lit("s")) == "s").alias("available"),
        url.alias("url"), F.coalesce(F.get("_d.images", 0)["cdnBaseUrl"], F.lit("")).alias("image_url"), F.lit(source).alias("source"),
        text(F.col("_d.geo.town.value")).alias("city"), text(F.col("_d.geo.region.value")).alias("region"), text(F.col("_d.date")).alias("published_at"),
        F.when(F.coalesce("_d.advertiser.company", F.lit(False)), "professionale").otherwise("privato").alias("seller_type"),
    ).where(F.col("name") != "")
    return out.where(is_relevant(F.col("name"), F.col("body_text"))) if strict else out


HIT_SCHEMA = T.StructType(
    [
        T.StructField("boxId", T.StringType()), T.StructField("boxName", T.StringType()), T.StructField("sellPrice", T.DoubleType()),
        T.StructField("ecomQuantity", T.LongType()), T.StructField("collectionQuantity", T.LongType()), T.StructField("categoryFriendlyName", T.StringType()),
    ]
)


def flatten_hits(df: DataFrame, url_base: str, source: str = "cex", prefix: str = "CEX") -> DataFrame:
    """Store search hits to offers; in stock when either quantity is positive."""
    stock = F.greatest(F.coalesce("ecomQuantity", F.lit(0)), F.coalesce("collectionQuantity", F.lit(0)))
    return df.select(
        F.trim(F.coalesce("boxName", F.lit(""))).alias("name"), F.concat(F.lit(prefix + "-"), "boxId").alias("sku"), F.col("sellPrice").alias("price"),
        format_price_it(F.col("sellPrice")).alias("price_display"), F.lit("Usato").alias("condition"),
        F.trim(F.regexp_extract(F.trim("boxName"), r"(?i),\s*(Imballata|Non Imballata|Scontata)\s*$", 1)).alias("grade"),
        F.coalesce("categoryFriendlyName", F.lit("")).alias("category"), (stock > 0).alias("available"),
        F.concat(F.lit(url_base), "boxId").alias("url"), F.lit("").alias("image_url"), F.lit(source).alias("source"),
    )


def flatten_sold(
    df: DataFrame, floor: float = catalog.DEFAULT_FLOOR, block: str = catalog.SOLD_BLOCK, allow: str = catalog.SOLD_ALLOW,
    source: str = "ebay", prefix: str = "EBAY",
) -> DataFrame:
    """Raw sold rows (title, price_text, sold_date, url, query_label) to offers."""
    title = F.trim(F.coalesce("title", F.lit("")))
    url = F.coalesce("url", F.lit(""))
    item = F.regexp_extract(url, r"/itm/(\d+)", 1)
    kept = (title != "") & (F.lower(title) != "shop on ebay") & ~matches(title, block) & matches(title, allow)
    return df.where(kept).select(
        title.alias("name"), F.when(item != "", F.concat(F.lit(prefix + "-"), item)).otherwise(stable_item_id(prefix, url)).alias("sku"),
        parse_price_eur(F.col("price_text")).alias("price"), F.trim(F.coalesce("sold_date", F.lit(""))).alias("sold_date"), url.alias("url"),
        F.col("query_label"), F.lit(source).alias("source"), F.lit(True).alias("available"),
    ).where(F.col("price") >= floor)


def expand_variants(products: DataFrame, variants: str = "variants") -> DataFrame:
    """One row per quality grade of a product; products without grades stay as they are.

    ``variants``: array of structs code, grade, available, price.
    """
    rows = products.select("*", F.posexplode_outer(variants).alias("_i", "_v")).drop(variants)
    has = F.col("_v").isNotNull()
    code = F.coalesce(F.nullif(F.col("_v.code"), F.lit("")), F.concat(F.lit("V"), (F.col("_i") + 1).cast("string")))
    graded = F.coalesce(F.col("_v.grade"), F.lit("")) != ""
    new = {
        "name": F.when(has & graded, F.concat("name", F.lit(" ["), "_v.grade", F.lit("]"))).otherwise(F.col("name")),
        "sku": F.when(has, F.concat("sku", F.lit("-"), code)).otherwise(F.col("sku")),
        "price": F.when(has, F.col("_v.price")).otherwise(F.col("price")),
        "price_display": F.when(has, format_price_it(F.col("_v.price"))).otherwise(F.col("price_display")),
        "available": F.when(has, F.col("_v.available")).otherwise(F.col("available")),
        "grade": F.when(has, F.col("_v.grade")).otherwise(F.col("grade")),
    }
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns if c not in ("_i", "_v")])


def variant_prices(df: DataFrame, base: str, buttons: str) -> DataFrame:
    """Adds ``variants`` from a base price and the texts of the grade buttons.

    ``buttons``: array of structs code, grade, text, disabled. A button names its difference to
    the base price; an unavailable grade has no price.
    """
    def one(b: Column) -> Column:
        text = F.translate(b["text"], "  ", "  ")
        delta = r"([+-])\s*([\d]+(?:[.,]\d+)?)\s*€"
        sign = F.when(F.regexp_extract(text, delta, 1) == "-", -1.0).otherwise(1.0)
        amount = F.coalesce(clean_price(F.regexp_extract(text, delta, 2)), F.lit(0.0))
        available = ~(F.coalesce(b["disabled"], F.lit(False)) | text.rlike(r"(?i)non\s+disponibile"))
        code = F.upper(F.trim(F.coalesce(b["code"], F.lit(""))))
        return F.struct(
            code.alias("code"), F.coalesce(F.nullif(F.trim(b["grade"]), F.lit("")), code).alias("grade"), available.alias("available"),
            F.when(available & F.col(base).isNotNull(), F.round(F.col(base) + sign * amount, 2)).alias("price"),
        )

    return df.withColumn("variants", F.transform(buttons, one))


def two_condition_cards(cards: DataFrame) -> DataFrame:
    """A card with a new and a used line to one row per line.

    ``cards``: name, base_sku, ribbon and lines, an array of structs label, in_stock, price_text.
    """
    rows = cards.select("*", F.explode("lines").alias("_l")).drop("lines")
    label = F.when(F.contains("_l.label", F.lit("Nuovo")), "Nuovo").when(F.contains("_l.label", F.lit("Usato")), "Usato")
    price = clean_price(F.col("_l.price_text"))
    gone = F.coalesce(F.col("ribbon"), F.lit("")).rlike(r"(?i)esaurit|non\s+disp")
    return rows.withColumn("condition", label).where(F.col("condition").isNotNull()).select(
        *[c for c in cards.columns if c not in ("lines", "base_sku")],
        F.concat("base_sku", F.when(F.col("condition") == "Usato", "_U").otherwise("_N")).alias("sku"), "condition", price.alias("price"),
        (F.col("_l.in_stock") & price.isNotNull() & ~gone).alias("available"),
    )
