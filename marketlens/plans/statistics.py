"""Price statistics per group of comparable offers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marketlens import catalog
from marketlens.functions import times
from marketlens.operators import windows
from marketlens.operators.ordering import null_safe_join
from marketlens.session import written

#: Neighbouring prices that K-means sums up once.
BLOCK = 4096


def _z(n: Column, low: Column, mean: Column, sd: Column) -> Column:
    return F.when(n > 2, F.when(sd == 0, F.lit(0.0)).otherwise((low - mean) / sd))


def _spread(price: str, ask: Sequence[str], bid: Sequence[str]) -> Column:
    positive = F.col(price) > 0
    at = lambda sources: F.when(F.col("source").isin(*sources) & positive, F.col(price))
    return F.min(at(ask)) - F.avg(at(bid))


def _margin(n: Column, sd: Column) -> Column:
    return F.when(n >= 2, F.lit(1.96) * sd / F.sqrt(n))


def z_score_of_min(df: DataFrame, key: str, price: str) -> DataFrame:
    """How unusual the lowest price is; from three prices on, 0 when all are equal."""
    g = df.where(F.col(price) > 0).groupBy(key).agg(
        F.count("*").alias("n"), F.min(price).alias("min_price"), F.avg(price).alias("_mean"), F.stddev_samp(price).alias("_sd")
    )
    return g.select(key, "n", "min_price", _z(F.col("n"), F.col("min_price"), F.col("_mean"), F.col("_sd")).alias("z_score"))


def bid_ask_spread(
    df: DataFrame, key: str, price: str, ask: Sequence[str] = catalog.ASK_SOURCES, bid: Sequence[str] = catalog.BID_SOURCES
) -> DataFrame:
    """Lowest store price less the mean private price; null when a side is missing."""
    return df.groupBy(key).agg(_spread(price, ask, bid).alias("spread"))


def linear_slope(daily: DataFrame, key: str) -> DataFrame:
    """Least-squares slope of the daily price against the day's index; needs two days.

    ``daily`` has one row per key and day, so a series is as long as the calendar.
    """
    points = F.sort_array(F.collect_list(F.struct("day", "price")))
    series = daily.groupBy(key).agg(points.alias("_s"))
    exploded = series.select(key, F.posexplode("_s").alias("_x", "_p"))
    fitted = exploded.groupBy(key).agg(F.count("*").alias("days"), F.regr_slope(F.col("_p.price"), F.col("_x")).alias("_b"))
    return fitted.select(key, "days", F.when(F.col("days") >= 2, F.col("_b")).alias("slope"))


def stockout_probability(log: DataFrame, key: str, entity: str, ts: str, available: str, tie: str, as_of: Column) -> DataFrame:
    """Chance of at least one sell-out in a day, from past 1→0 steps of the key's entities."""
    gone = windows.availability_transitions(log, entity, ts, available, tie).groupBy(key).agg(F.count("*").alias("_events"))
    first = log.groupBy(key).agg(F.min(ts).alias("_first"))
    joined = null_safe_join(first, gone, [key], "left")
    days = F.greatest(F.lit(1.0), (times.micros(as_of) - times.micros(F.col("_first"))) / 86_400_000_000.0)
    rate = F.coalesce("_events", F.lit(0)) / days
    return joined.select(key, F.coalesce("_events", F.lit(0)).alias("events"), (1 - F.exp(-rate)).alias("stockout_probability"))


def storage_correlation(df: DataFrame, keys: Sequence[str], size: str, price: str) -> DataFrame:
    """Pearson correlation of size and price; null with one size, 0 without variance."""
    rows = df.where((F.col(price) > 0) & (F.col(size) > 0))
    x, y = F.col(size).cast("double"), F.col(price).cast("double")
    g = rows.groupBy(*keys).agg(
        F.count_distinct(size).alias("_sizes"), F.covar_pop(x, y).alias("_cov"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy")
    )
    flat = (F.col("_sx") == 0) | (F.col("_sy") == 0)
    r = F.when(flat, F.lit(0.0)).otherwise(F.col("_cov") / F.nullif(F.col("_sx") * F.col("_sy"), F.lit(0.0)))
    return g.select(*keys, F.col("_sizes").alias("sizes"), F.when(F.col("_sizes") >= 2, r).alias("correlation"))


def shrunk_premium(
    df: DataFrame, combo: str, model: Sequence[str], standard: Column, price: str, prior: float = 30.0, strength: int = 3
) -> DataFrame:
    """Premium of a combo over the standard edition of its model and size, pulled towards ``prior``."""
    rows = df.where(F.col(price) > 0)
    base = rows.where(standard).groupBy(*model).agg(F.avg(price).alias("_std"))
    own = rows.groupBy(combo, *model).agg(F.count("*").alias("n"), F.avg(price).alias("_mean"))
    joined = null_safe_join(own, base, model)
    premium = (F.col("n") * (F.col("_mean") - F.col("_std")) + strength * prior) / (F.col("n") + strength)
    return joined.select(combo, *model, "n", premium.alias("premium"))


def mean_ci95(df: DataFrame, key: str, price: str) -> DataFrame:
    """95% interval of the mean; null below two prices, ``volatile`` when the margin passes a quarter of it."""
    g = df.where(F.col(price) > 0).groupBy(key).agg(F.count("*").alias("n"), F.avg(price).alias("mean"), F.stddev_samp(price).alias("_sd"))
    out = g.withColumn("margin", _margin(F.col("n"), F.col("_sd")))
    return out.select(
        key, "n", "mean", "margin", F.greatest(F.lit(0.0), F.col("mean") - F.col("margin")).alias("_l"),
        (F.col("mean") + F.col("margin")).alias("upper"), (F.col("margin") / F.col("mean") > 0.25).alias("volatile"),
    ).withColumn("lower", F.when(F.col("margin").isNotNull(), F.col("_l"))).drop("_l")


def feature_value(df: DataFrame, key: str, flag: str, price: str) -> DataFrame:
    """Mean price with the feature less the mean without; null when a side is missing."""
    p = F.when(F.col(price) > 0, F.col(price))
    return df.groupBy(key).agg((F.avg(F.when(F.col(flag) == 1, p)) - F.avg(F.when(F.col(flag) == 0, p))).alias("feature_value"))


def _lloyd(prices: np.ndarray, weights: np.ndarray, k: int, max_rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and the band of each price, for one key of bounded size."""
    low, high = prices.min(), prices.max()
    centroids = np.array([low + (high - low) * (i / (k - 1) if k > 1 else 0.0) for i in range(k)])
    band = np.zeros(len(prices), dtype=int)
    for _ in range(max_rounds):
        band = np.abs(prices[:, None] - centroids[None, :]).argmin(axis=1)
        total = np.bincount(band, weights=weights, minlength=k)
        means = np.divide(np.bincount(band, weights=prices * weights, minlength=k), total, out=centroids.copy(), where=total > 0)
        moved = np.abs(means - centroids) > tolerance
        if not moved.any():
            break
        centroids = np.where(moved, means, centroids)
    return centroids, band


def kmeans_1d(
    df: DataFrame, key: str, price: str, k: int = 3, max_rounds: int = 50, tolerance: float = 0.1, *, in_task: int = 1_000_000
) -> DataFrame:
    """Price bands per key: key, cluster, centroid, size.

    Centroids start evenly spaced and move only by more than ``tolerance``; groups below ``k``
    prices become single bands. Rows are first counted per distinct price. Keys of at most
    ``in_task`` distinct prices are settled in one task each; larger ones go round by round over
    sums of blocks of neighbouring prices, so a key may hold any number of rows. Counted prices and key
    sizes are written, so that a short list of keys goes to the prices and these stay where they are.
    """
    rows = df.where(F.col(price) > 0).select(key, F.col(price).cast("double").alias("_p"))
    points = written(rows.groupBy(key, "_p").agg(F.count("*").alias("_c")), "points")
    size = written(points.groupBy(key).agg(
        F.sum("_c").alias("_n"), F.count("*").alias("_d"), F.min("_p").alias("_lo"), F.max("_p").alias("_hi")
    ), "sizes")
    of_size = lambda test: null_safe_join(points, size.where(test).select(key), [key])
    kind = dict(points.dtypes)[key]

    def settle_key(pdf: pd.DataFrame) -> pd.DataFrame:
        centroids, band = _lloyd(pdf["_p"].to_numpy(), pdf["_c"].to_numpy(float), k, max_rounds, tolerance)
        total = np.bincount(band, weights=pdf["_c"].to_numpy(float), minlength=k).astype(int)
        used = np.flatnonzero(total)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(used), "cluster": used, "centroid": centroids[used], "size": total[used]})

    dense = of_size((F.col("_n") >= k) & (F.col("_d") <= in_task))
    out = dense.groupBy(key).applyInPandas(settle_key, f"`{key}` {kind}, cluster long, centroid double, size long")
    # Fewer than k rows per key here.
    tiny = of_size(F.col("_n") < k).select(key, "_p", F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("_r"))
    singles = tiny.groupBy(key).agg(F.sort_array(F.collect_list("_p")).alias("_ps")).select(key, F.posexplode("_ps").alias("cluster", "centroid"))
    out = out.unionByName(singles.select(key, F.col("cluster").cast("long").alias("cluster"), "centroid", F.lit(1).cast("long").alias("size")))
    large = size.where((F.col("_n") >= k) & (F.col("_d") > in_task))
    if large.isEmpty():
        return out
    wide = _kmeans_rounds(points, large, key, k, max_rounds, tolerance)
    return out.unionByName(wide)


def _kmeans_rounds(points: DataFrame, size: DataFrame, key: str, k: int, max_rounds: int, tolerance: float) -> DataFrame:
    """Rounds for the keys of ``size``; each has many prices, so their centroids are few rows and go to the prices.

    Prices are sorted once and summed up in blocks of ``BLOCK``. Bands are intervals, so a block whose
    lowest and highest price fall into one band does so as a whole; only the blocks on a border
    (at most one per border and key) are read price by price.
    """
    mine = null_safe_join(points, F.broadcast(size.select(key)), [key])
    numbered = mine.repartitionByRange(key, "_p").sortWithinPartitions(key, "_p").withColumn("_b", F.floor(F.monotonically_increasing_id() / BLOCK))
    line = written(numbered, "line")
    blocks = written(line.groupBy(key, "_b").agg(
        F.min("_p").alias("_lo"), F.max("_p").alias("_hi"), F.sum(F.col("_p") * F.col("_c")).alias("_s"), F.sum("_c").alias("_c")
    ), "blocks")

    def band(price: str) -> Column:
        gaps = [F.abs(F.col(price) - F.col(f"_m{j}")) for j in range(k)]
        nearest = F.least(*gaps) if k > 1 else gaps[0]
        out = F.lit(k - 1)
        for j in reversed(range(k - 1)):
            out = F.when(gaps[j] == nearest, j).otherwise(out)
        return out

    def assigned(centroids: DataFrame) -> DataFrame:
        """Blocks and single prices with their band ``_j``: ``_s`` and ``_c`` are their sum and count."""
        placed = null_safe_join(blocks, F.broadcast(centroids), [key]).withColumn("_j", band("_lo"))
        split = [r["_b"] for r in placed.where(F.col("_j") != band("_hi")).select("_b").distinct().collect()]
        on_border = F.lit(False)
        # Short lists, because Parquet skips pages only by these.
        for i in range(0, len(split), 10):
            on_border = on_border | F.col("_b").isin(split[i:i + 10])
        singles = null_safe_join(line.where(on_border), F.broadcast(centroids), [key]).withColumn("_j", band("_p"))
        columns = [key, *[f"_m{j}" for j in range(k)], "_j"]
        return placed.where(~on_border).select(*columns, "_s", "_c").unionByName(singles.select(*columns, (F.col("_p") * F.col("_c")).alias("_s"), "_c"))

    def one_round(centroids: DataFrame) -> DataFrame:
        # One row per key; keys whose centroids rest come out as they went in.
        sums = assigned(centroids).groupBy(key).agg(
            *[F.first(f"_m{j}").alias(f"_m{j}") for j in range(k)],
            *[F.sum(F.when(F.col("_j") == j, F.col("_s"))).alias(f"_s{j}") for j in range(k)],
            *[F.sum(F.when(F.col("_j") == j, F.col("_c"))).alias(f"_n{j}") for j in range(k)],
        )
        means = [F.col(f"_s{j}") / F.col(f"_n{j}") for j in range(k)]
        moves = [F.coalesce(F.abs(means[j] - F.col(f"_m{j}")) > tolerance, F.lit(False)) for j in range(k)]
        moved = moves[0]
        for m in moves[1:]:
            moved = moved | m
        return sums.select(key, *[F.when(moves[j], means[j]).otherwise(F.col(f"_m{j}")).alias(f"_m{j}") for j in range(k)], moved.alias("_moved"))

    spread = F.col("_hi") - F.col("_lo")
    start = [(F.col("_lo") + spread * F.lit(i / (k - 1) if k > 1 else 0.0)).alias(f"_m{i}") for i in range(k)]
    before = current = written(size.select(key, *start), "centroids")
    for _ in range(max_rounds):
        before, current = current, written(one_round(current), "centroids")
        if current.where("_moved").isEmpty():
            break
        current = current.drop("_moved")
    # Sizes belong to the last assignment, made with the centroids before the last move.
    counted = assigned(before).groupBy(key, "_j").agg(F.sum("_c").alias("size"))
    joined = null_safe_join(counted, current, [key])
    moved_to = F.array(*[F.col(f"_m{j}") for j in range(k)])
    return joined.select(key, F.col("_j").cast("long").alias("cluster"), moved_to[F.col("_j")].alias("centroid"), "size")


def price_trend(daily: DataFrame, key: str, since: Column | None = None) -> DataFrame:
    """Current, lowest and highest daily price of keys with at least two days."""
    kept = daily if since is None else daily.where(F.col("day") >= since)
    g = kept.groupBy(key).agg(
        F.count("*").alias("days"), F.max_by("price", "day").alias("current_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price")
    )
    return g.where(F.col("days") >= 2)


def price_timeline(changes: DataFrame) -> DataFrame:
    """Points of a price chart, with the step of every price change."""
    kept = changes.where(F.col("change_type").isin("new", "price", "both") & F.col("price_new").isNotNull())
    step = F.when(F.col("change_type").isin("price", "both") & F.col("price_old").isNotNull(), F.col("price_new") - F.col("price_old"))
    return kept.withColumn("price_step", step)


def price_history(changes: DataFrame, types: Sequence[str] = ("new", "price", "availability")) -> DataFrame:
    return changes.where(F.col("change_type").isin(*types)).select("product_id", "changed_at", "price_new", "available_new")


def model_statistics(items: DataFrame, log: DataFrame, as_of: Column, *, key: str = "combo_key", price: str = "price", members: DataFrame | None = None) -> DataFrame:
    """The statistics of every combo side by side.

    ``items``: combo_key, source, price, family, segment, storage, storage_gb, edition, has_kinect.
    ``log``: combo_key, product_id, changed_at, price_new, available_new, change_id.
    """
    daily = windows.daily_min(log, key, "changed_at", "price_new")
    corr = storage_correlation(items, ["family", "segment"], "storage_gb", price).drop("sizes")
    standard = F.coalesce(F.lower("edition"), F.lit("standard")).isin("standard", "")
    premium = shrunk_premium(items, key, ["family", "segment", "storage"], standard, price).groupBy(key).agg(F.max("premium").alias("premium"))
    bands = kmeans_1d(items, key, price).groupBy(key).agg(
        # At most as many bands as clusters.
        F.sort_array(F.collect_list(F.struct("centroid", "size"))).alias("bands")
    )
    # Everything that is a plain aggregate of the items comes from one pass.
    p = F.when(F.col(price) > 0, F.col(price))
    plain = items.groupBy(key).agg(
        F.min("family").alias("family"), F.min("segment").alias("segment"), F.count(p).alias("n"), F.min(p).alias("min_price"),
        F.avg(p).alias("_mean"), F.stddev_samp(p).alias("_sd"), _spread(price, catalog.ASK_SOURCES, catalog.BID_SOURCES).alias("spread"),
    )
    margin = _margin(F.col("n"), F.col("_sd"))
    out = plain.select(
        key, "family", "segment", "n", "min_price", _z(F.col("n"), F.col("min_price"), F.col("_mean"), F.col("_sd")).alias("z_score"), "spread",
        margin.alias("margin"), (margin / F.col("_mean") > 0.25).alias("volatile"),
    )
    for part in (
        windows.ema(daily, key).drop("days"), linear_slope(daily, key).drop("days"),
        stockout_probability(log, key, "product_id", "changed_at", "available_new", "change_id", as_of).drop("events"), bands, premium,
    ):
        out = null_safe_join(out, part, [key], "left")
    out = null_safe_join(out, corr, ["family", "segment"], "left")
    by_family = feature_value(items, "family", "has_kinect", price)
    return null_safe_join(out, by_family, ["family"], "left")
