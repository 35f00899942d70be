"""Numbering, de-duplication, transitions, series, top rows and pools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketlens import catalog
from marketlens.functions.scores import lookup
from marketlens.functions.urls import simple_url
from marketlens.operators.ordering import null_safe_join, number_rows, order_statistics, previous_row


# --- numbering ----------------------------------------------------------------------------

def display_ids(
    products: DataFrame, prefixes: dict[str, int] = catalog.SOURCE_PREFIX, other: int = catalog.OTHER_PREFIX,
    conditions: dict[str, int] = catalog.CONDITION_RANK, base: int = 1000,
) -> DataFrame:
    """``display_id`` = source prefix and rank by name, condition and id.

    ``rank_fits`` is false where the rank has outgrown the digits left for it.
    """
    def text(c: str) -> Column:
        return F.trim(F.coalesce(F.col(c), F.lit("")))

    prefix = F.coalesce(lookup(prefixes, F.lower(text("source"))), F.lit(other)) if prefixes else F.lit(other)
    rank = F.coalesce(lookup(conditions, text("condition")), F.lit(9)) if conditions else F.lit(9)
    rows = products.select(
        "*", F.lower(text("source")).alias("_src"), F.lower(text("name")).alias("_name"), rank.alias("_cond"),
        F.lower(text("condition")).alias("_condition"), prefix.cast("long").alias("_prefix"),
    )
    numbered = number_rows(rows, [F.col("_name"), F.col("_cond"), F.col("_condition"), F.col("id")], ["_src"], out="_seq")
    return numbered.withColumn("display_id", F.col("_prefix") * base + F.col("_seq")).withColumn(
        "rank_fits", F.col("_seq") < base
    ).drop("_src", "_name", "_cond", "_condition", "_prefix", "_seq")


# --- de-duplication -----------------------------------------------------------------------

def dedupe_first(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ("sku", "url", "name")) -> DataFrame:
    """First row per first non-empty key; rows whose keys are all empty drop out."""
    key = F.coalesce(*[F.when(F.coalesce(F.col(k), F.lit("")) != "", F.col(k)) for k in keys])
    keyed = df.withColumn("_key", key).where(F.col("_key").isNotNull())
    packed = F.struct(*df.columns)
    first = keyed.groupBy("_key").agg(F.min_by(packed, F.struct(*[F.col(o) for o in order])).alias("_row"))
    return first.select("_row.*")


def fold_rows(
    rows: DataFrame, keys: Sequence[str], survivor: Sequence[str | Column], latest: Sequence[str | Column], *,
    newest: Sequence[str] = (), any_flag: Sequence[str] = (), earliest: Sequence[str] = (), last: Sequence[str] = (), own: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Merges the rows of each key into one.

    The survivor (largest ``survivor`` order) gives its id and the ``own`` columns; ``newest``
    columns take the latest non-null value, ``any_flag`` columns are or-ed, ``earliest`` and
    ``last`` keep their minimum and maximum. Second result: old id to surviving id.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    best = F.struct(*[as_col(c).alias(f"o{i}") for i, c in enumerate(survivor)])
    recent = F.struct(*[as_col(c).alias(f"o{i}") for i, c in enumerate(latest)])
    aggs = [F.max_by("id", best).alias("id")]
    aggs += [F.max_by(c, best).alias(c) for c in own]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), recent)).alias(c) for c in newest]
    aggs += [F.max(c).alias(c) for c in (*any_flag, *last)] + [F.min(c).alias(c) for c in earliest]
    merged = rows.groupBy(*keys).agg(*aggs)
    moved = null_safe_join(rows.select("id", *keys).withColumnRenamed("id", "old_id"), merged.select(*keys, F.col("id").alias("new_id")), keys)
    return merged, moved.where(F.col("old_id") != F.col("new_id")).select("old_id", "new_id")


# --- fixed values: columns that the newest of merged products gives -------------------------
PRODUCT_NEWEST = (
    "sku", "category_id", "storage_id", "console_family", "model_segment", "edition_class", "canonical_model",
    "classify_confidence", "classify_method", "standard_name", "standard_key", "packaging_state", "url", "image_url",
    "last_price", "last_available",
)


def dedupe_by_url(products: DataFrame, sources: Sequence[str] = catalog.URL_KEYED_SOURCES) -> tuple[DataFrame, DataFrame]:
    """One product per normal URL in the given sources: longest name, then latest seen, then highest id."""
    url = simple_url(F.col("url"))
    keyed = products.withColumn("_url", url)
    subject = F.col("source").isin(*sources) & (F.col("_url") != "")
    merged, moved = fold_rows(
        keyed.where(subject), ["source", "_url"], [F.length(F.coalesce("name", F.lit(""))), "last_seen", "id"], ["last_seen", "id"],
        newest=[c for c in PRODUCT_NEWEST if c in products.columns],
        any_flag=[c for c in ("is_base_model", "is_base_model_auto") if c in products.columns],
        earliest=["first_seen"], last=["last_seen"],
        own=[c for c in products.columns if c not in PRODUCT_NEWEST and c not in ("id", "source", "is_base_model", "is_base_model_auto", "first_seen", "last_seen")],
    )
    rest = keyed.where(~F.coalesce(subject, F.lit(False))).select(*products.columns)
    return rest.unionByName(merged.select(*products.columns)), moved


def repoint(changes: DataFrame, moved: DataFrame, fk: str) -> DataFrame:
    """Change rows of merged entities go to the survivor; one row per old id on the right."""
    joined = changes.join(moved, changes[fk] == F.col("old_id"), "left")
    return joined.withColumn(fk, F.coalesce("new_id", fk)).drop("old_id", "new_id")


def keep_max_per_source(items: DataFrame, group: str, source: str = catalog.VARIANT_SOURCE, price: str = "price", order: str = "id") -> DataFrame:
    """Of several rows of ``source`` in a group only the dearest stays, the first on a tie."""
    of_source = F.col("source") == source
    ranked = F.struct(F.coalesce(price, F.lit(0.0)).alias("p"), (-F.col(order)).alias("o"))
    best = items.where(of_source).groupBy(group).agg(F.max_by(order, ranked).alias("_keep"))
    kept = null_safe_join(items.where(of_source), best, [group]).where(F.col(order) == F.col("_keep")).drop("_keep")
    return items.where(~F.coalesce(of_source, F.lit(False))).unionByName(kept)


# --- transitions and series ---------------------------------------------------------------

def availability_transitions(log: DataFrame, key: str, ts: str, available: str, tie: str) -> DataFrame:
    """Every 1→0 step of an entity."""
    prev = previous_row(log, [key], [ts, tie], [available])
    return prev.where((F.col(f"prev_{available}") == 1) & (F.col(available) == 0)).drop("has_prev", f"prev_{available}")


def status_transitions(runs: DataFrame, job: str = "job", status: str = "status", order: str = "id") -> DataFrame:
    """Runs, with ``alert`` set where the status changes into warn or error."""
    prev = previous_row(runs, [job], [order], [status])
    bad = F.col(status).isin("warn", "error")
    return prev.withColumn("alert", bad & ~F.col(status).eqNullSafe(F.col(f"prev_{status}"))).drop("has_prev")


def alert_set_changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Whether the jobs in error or warn differ from last time; both have job and status."""
    bad = lambda df: df.where(F.col("status").isin("warn", "error")).select("job", "status")
    moved = bad(now).exceptAll(bad(before)).unionByName(bad(before).exceptAll(bad(now)))
    counts = moved.agg(F.count("*").alias("differences"))
    both = counts.withColumn("bad_jobs", bad(now).agg(F.count("*")).scalar())
    return both.withColumn("changed", F.col("differences") > 0).withColumn("fires", F.col("changed") & (F.col("bad_jobs") > 0))


def daily_min(log: DataFrame, key: str, ts: str, price: str) -> DataFrame:
    return log.where(F.col(price) > 0).groupBy(key, F.to_date(ts).alias("day")).agg(F.min(price).alias("price"))


def ema(daily: DataFrame, key: str, periods: int = 7) -> DataFrame:
    """Exponential average over daily prices (one row per key and day), null below two days."""
    k = 2.0 / (periods + 1)
    points = F.sort_array(F.collect_list(F.struct("day", "price")))
    series = daily.groupBy(key).agg(points.alias("_s"))
    start = F.col("_s")[0]["price"]
    folded = F.aggregate(
        F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(1))), start, lambda acc, p: p["price"] * k + acc * (1 - k)
    )
    return series.select(key, F.size("_s").cast("long").alias("days"), F.when(F.size("_s") >= 2, folded).alias("ema"))


# --- top rows, orders, samples ------------------------------------------------------------

def cheapest(ads: DataFrame, limit: int | None, price: str = "last_price", tie: str | Sequence[str] = "id") -> DataFrame:
    ties = [tie] if isinstance(tie, str) else list(tie)
    rows = ads.where((F.col("last_available") == 1) & (F.col(price) > 0)).orderBy(price, *ties)
    return rows if limit is None else rows.limit(limit)


def all_ads(ads: DataFrame, price: str = "last_price", tie: str = "id") -> DataFrame:
    """Every listing by family, then price; missing prices last."""
    return ads.orderBy("console_family", F.col(price).asc_nulls_last(), tie)


def sold_listings(ads: DataFrame, sold: str = "sold_at", tie: str = "id") -> DataFrame:
    """Every sold listing, newest sale first."""
    return ads.where(F.col(sold).isNotNull()).orderBy(F.col(sold).desc(), tie)


def newest_sold(items: DataFrame, limit: int, seen: str = "first_seen", tie: str = "id") -> DataFrame:
    return items.orderBy(F.col(seen).desc_nulls_last(), tie).limit(limit)


def by_rank(df: DataFrame, column: str, order: Sequence[str], out: str = "rank", missing: int = 99) -> DataFrame:
    """Adds the position of a value in a custom order."""
    return df.withColumn(out, F.coalesce(lookup({v: i for i, v in enumerate(order)}, F.col(column)), F.lit(missing)).cast("long"))


def sort_view(df: DataFrame, column: str, descending: bool = False, tie: str = "id") -> DataFrame:
    """Missing values count as infinitely large."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last(), tie)


def verification_order() -> list[Column]:
    return [
        F.when(F.col("verify_status") == "pending", 0).otherwise(1),
        F.coalesce("last_seen", "first_seen").asc_nulls_first(), F.col("id"),
    ]


def sample_share(rows: DataFrame, ratio: float, seed: int, key: str = "id") -> DataFrame:
    """``floor(n * ratio)`` rows in a repeatable pseudo-random order.

    The upper half of the hash at the wanted rank is found by counting, so rows below it are
    taken by a filter where they are; only those at that very value are numbered.
    """
    wanted = F.floor(F.col("_n") * F.lit(ratio))
    marked = rows.withColumn("_r", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_half", F.shiftright("_r", 32))
    rank = F.greatest(wanted, F.lit(1))
    border = order_statistics(marked.select("_half"), [], "_half", [(ratio, rank, rank)]).select(
        F.col("_at")[0]["low"].cast("long").alias("half"), (wanted - F.col("_at")[0]["low_below"]).alias("left")
    )
    at, left = border.select("half").scalar(), border.select("left").scalar()
    below = marked.where(F.col("_half") < at).drop("_r", "_half")
    edge = number_rows(marked.where(F.col("_half") == at), [F.col("_r"), F.col(key)], out="_no")
    return below.unionByName(edge.where(F.col("_no") <= left).drop("_r", "_half", "_no"))


def random_probe(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """``n`` rows in an order by a hash of ``key`` and ``seed``, the same however rows are partitioned."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key), F.lit(seed)).cast("binary")), F.col(key)).limit(n)


def market_order(rows: DataFrame, group: str, mode: str, price: str = "last_price", sold: str = "sold_at", tie: str = "id") -> DataFrame:
    """Position inside a group: cheapest first on sale, newest first once sold."""
    first = F.coalesce(F.col(price), F.lit(float("inf"))) if mode in ("approved", "pending") else -F.unix_micros(F.col(sold).cast("timestamp"))
    rows = rows.withColumn("_first", first)
    return number_rows(rows, [F.col("_first").asc_nulls_last(), F.col(tie)], [group], out="position").drop("_first")


# --- pools --------------------------------------------------------------------------------

def pool(frames: Sequence[DataFrame]) -> DataFrame:
    """Offers of different shape under the union of their columns; ``pool_rank`` keeps the order."""
    out = None
    for i, df in enumerate(frames):
        ranked = df.withColumn("pool_rank", F.lit(i))
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
    return out
