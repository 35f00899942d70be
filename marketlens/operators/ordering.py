"""Row numbers, previous rows and exact order statistics that no hot group can sink.

A plain window puts every row of a key into one task. The functions here keep the same
results while one key may hold a large share of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketlens.session import written

#: Distinct values of a key that one task may rank.
RANKED = 200_000
#: Sub-buckets of a bracket in one round.
_BUCKETS = 4096


def number_rows(df: DataFrame, order: Sequence[Column], groups: Sequence[str] = (), out: str = "row_no") -> DataFrame:
    """Exact ``row_number`` per group in ``order``.

    Rows are range-partitioned and sorted, so a hot group spreads over many tasks; the
    position inside a task comes from the row id, and only one row per (task, group) is
    needed to turn it into a global number.
    """
    keys = [F.col(g) for g in groups]
    sorted_rows = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    fixed = written(sorted_rows, "sorted").withColumn("_task", F.shiftright("_at", 33))
    runs = fixed.groupBy("_task", *groups).agg(F.min("_at").alias("_start"), F.count("*").alias("_len"))
    earlier = Window.partitionBy(*groups).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "_task", *groups, "_start", F.coalesce(F.sum("_len").over(earlier), F.lit(0)).alias("_before")
    )
    joined = null_safe_join(fixed, runs, ["_task", *groups])
    return joined.withColumn(out, F.col("_at") - F.col("_start") + F.col("_before") + 1).drop(
        "_at", "_task", "_start", "_before"
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null matches null; the right side's keys are dropped."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    condition = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[f"_r_{k}"])
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Adds ``has_prev`` and the previous row's values within the key, in ``order`` (unique in a key).

    A segmented scan: rows are range-sorted by key and order, so one key, or one moment of one
    key, spreads over as many tasks as its rows need. Each task looks back among its own rows; the
    first row of a task gets the last row of the task before it from a table of one row per task.
    """
    along = [*keys, *order]
    sorted_rows = df.repartitionByRange(*along).sortWithinPartitions(*along).withColumn("_at", F.monotonically_increasing_id())
    fixed = written(sorted_rows, "sorted").withColumn("_task", F.shiftright("_at", 33))
    packed = F.struct(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    local = fixed.withColumn("_before", F.lag(packed).over(Window.partitionBy("_task").orderBy("_at")))
    ends = fixed.join(fixed.groupBy("_task").agg(F.max("_at").alias("_end")), ["_task"]).where(F.col("_at") == F.col("_end"))
    carried = ends.select("_task", F.lag(packed).over(Window.orderBy("_task")).alias("_carried"))
    near = local.join(carried, "_task").withColumn("_prev", F.coalesce("_before", "_carried"))
    same = F.col("_prev").isNotNull()
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_prev.key.k{i}"))
    out = near.withColumn("has_prev", same)
    for i, v in enumerate(values):
        out = out.withColumn(prefix + v, F.when(F.col("has_prev"), F.col(f"_prev.v{i}")))
    return out.drop("_at", "_task", "_before", "_carried", "_prev")


def nearest_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, low: str = "low", high: str = "high") -> DataFrame:
    """Adds the last non-null ``value`` up to a row and the first one from it on, within the key and in ``order`` (unique in a key).

    The two-sided form of :func:`previous_row`: rows are range-sorted by key and order, each task
    looks both ways among its own rows, and what lies beyond is carried between tasks by a table
    of one row per task and key. Nulls in the keys are a key of their own.
    """
    along = [*keys, *order]
    sorted_rows = df.repartitionByRange(*along).sortWithinPartitions(*along).withColumn("_at", F.monotonically_increasing_id())
    fixed = written(sorted_rows, "sorted").withColumn("_task", F.shiftright("_at", 33))
    known = F.when(F.col(value).isNotNull(), F.col("_at"))
    ends = fixed.groupBy("_task", *keys).agg(F.max_by(value, known).alias("_last"), F.min_by(value, known).alias("_first"))
    # Windows run towards the row from either side, so that none is counted anew for each row.
    before, upto = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)
    tasks, here = Window.partitionBy(*keys), Window.partitionBy("_task", *keys)
    carried = ends.select(
        "_task", *keys,
        F.last("_last", ignorenulls=True).over(tasks.orderBy("_task").rowsBetween(*before)).alias("_below"),
        F.last("_first", ignorenulls=True).over(tasks.orderBy(F.col("_task").desc()).rowsBetween(*before)).alias("_above"),
    )
    local = fixed.withColumn("_l", F.last(value, ignorenulls=True).over(here.orderBy("_at").rowsBetween(*upto))).withColumn(
        "_h", F.last(value, ignorenulls=True).over(here.orderBy(F.col("_at").desc()).rowsBetween(*upto))
    )
    both = null_safe_join(local, carried, ["_task", *keys])
    return both.withColumns({low: F.coalesce("_l", "_below"), high: F.coalesce("_h", "_above")}).drop("_at", "_task", "_l", "_h", "_below", "_above")


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, targets: Sequence[tuple[float, Column, Column]],
    *, spread: float = 0.002, accuracy: int = 2000, extra: Sequence[Column] = (), extra_names: Sequence[str] = (),
) -> DataFrame:
    """Exact values at given ranks, one row per key.

    ``targets`` are (share, low rank, high rank); ranks are 1-based, may use ``_n`` and lie
    within two of ``share * _n``. A mergeable sketch brackets each rank within ``spread`` of
    all rows (the whole range for groups too small for that); the second pass counts what is
    below the bracket and keeps the distinct values inside it. Where a bracket could still hold
    more than ``RANKED`` values, it is counted in sub-buckets, the ones that hold the wanted ranks
    are kept, and so on (``_refined``); a task never ranks more values than that. Null values are
    left out.

    ``extra`` are further aggregates of the first pass, named ``extra_names``.

    Result: keys, the extras, ``_n`` and ``_at``, an array of structs (i, low, high, low_below, low_upto,
    high_below, high_upto) in the order of ``targets``.
    """
    valued = df.withColumn("_v", F.col(value).cast("double")).where(F.col("_v").isNotNull())
    rows = valued.select(*keys, "_v")
    shares = [p for p, _, _ in targets]
    edges = [min(max(p + d, 0.0), 1.0) for p in shares for d in (-spread, spread)]
    seen = valued.groupBy(*keys).agg(
        *extra,
        F.count("*").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", edges, accuracy).alias("_e"),
    )
    # One row per key; a known small size lets the second pass keep its rows where they are.
    seen = written(seen, "seen")
    most = seen.agg(F.max("_n")).first()[0] or 0
    small = F.col("_n") <= int(4 / spread)
    brackets = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.when(small | F.lit(shares[i] - spread <= 0), F.col("_min")).otherwise(F.col("_e")[2 * i]).alias("lo"),
                F.when(small | F.lit(shares[i] + spread >= 1), F.col("_max")).otherwise(F.col("_e")[2 * i + 1]).alias("hi"),
            )
            for i in range(len(targets))
        ]
    )
    # The extras depend on the key alone, so grouping by them changes nothing.
    named = [*extra_names, "_n"]
    if keys:
        near = null_safe_join(rows, seen.select(*keys, *named, brackets.alias("_b")), keys)
    else:
        one = seen.select(F.struct(*named, brackets.alias("_b"))).scalar()
        near = rows.withColumn("_one", one).select("_v", *[F.col("_one")[c].alias(c) for c in (*named, "_b")])
    # Side of each bracket, two bits per target: 0 inside, 1 below, 2 above. Rows outside all
    # brackets collapse to one counter per key and code before any shuffle.
    code, inside = F.lit(0), F.lit(False)
    for i in range(len(targets)):
        b = F.col("_b")[i]
        side = F.when(F.col("_v") < b["lo"], 1).when(F.col("_v") > b["hi"], 2).otherwise(0)
        code = code + side * (1 << (2 * i))
        inside = inside | F.col("_v").between(b["lo"], b["hi"])
    counted = (
        near.select(*keys, *named, code.alias("_code"), F.when(inside, F.col("_v")).alias("_w"))
        .groupBy(*keys, *named, "_code", "_w")
        .agg(F.count("*").alias("_c"))
    )
    if len(targets) == 1:
        sided = counted.withColumn("_i", F.lit(0)).withColumn("_side", F.col("_code"))
    else:
        sided = counted.withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(len(targets))]))).withColumn(
            "_side", F.expr("shiftright(_code, 2 * _i) & 3")
        )
    placed = sided.where(F.col("_side") != 2).withColumn("_w", F.when(F.col("_side") == 0, F.col("_w")))
    if len(targets) > 1:
        # Rows outside one bracket may lie inside another, so several codes count as below.
        placed = placed.groupBy(*keys, *named, "_i", "_w").agg(F.sum("_c").alias("_c"))
    low = high = None
    for i, (_, lo_rank, hi_rank) in enumerate(targets):
        low = F.when(F.col("_i") == i, lo_rank) if low is None else low.when(F.col("_i") == i, lo_rank)
        high = F.when(F.col("_i") == i, hi_rank) if high is None else high.when(F.col("_i") == i, hi_rank)
    # The sketch may miss a rank by its own error on either side of the bracket.
    if most * (2 * spread + 2 / accuracy) > RANKED:
        placed = _refined(placed, [*keys, *named, "_i"], low, high)
    else:
        placed = placed.withColumn("_for", F.lit("both"))
    upto = Window.partitionBy(*keys, "_i", "_for").orderBy(F.col("_w").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    ranked = placed.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_below", F.col("_upto") - F.col("_c"))
    at_low = (F.col("_for") != "high") & (F.col("_below") < low) & (low <= F.col("_upto"))
    at_high = (F.col("_for") != "low") & (F.col("_below") < high) & (high <= F.col("_upto"))
    per_target = ranked.groupBy(*keys, *named, "_i").agg(
        F.max(F.when(at_low, F.col("_w"))).alias("low"),
        F.max(F.when(at_high, F.col("_w"))).alias("high"),
        F.max(F.when(at_low, F.col("_below"))).alias("low_below"),
        F.max(F.when(at_low, F.col("_upto"))).alias("low_upto"),
        F.max(F.when(at_high, F.col("_below"))).alias("high_below"),
        F.max(F.when(at_high, F.col("_upto"))).alias("high_upto"),
    )
    found = F.col("low").isNotNull() & F.col("high").isNotNull()
    checked = F.when(found, F.col("_i")).otherwise(F.raise_error(F.lit("rank outside its bracket")).cast("int"))
    stat = F.struct(
        checked.alias("i"), "low", "high", "low_below", "low_upto", "high_below", "high_upto"
    )
    # As many structs per key as there are targets.
    return per_target.groupBy(*keys, *named).agg(F.sort_array(F.collect_list(stat)).alias("_at"))


def _refined(placed: DataFrame, groups: Sequence[str], low: Column, high: Column) -> DataFrame:
    """Distinct values around each wanted rank, at most ``RANKED`` of a group, and one row for all below.

    ``placed`` has the groups, a value ``_w`` (null: below all others) and its count ``_c``; the
    result has them once for the rank ``low`` and once for ``high``, told apart by ``_for``. A round
    counts every group's values in sub-buckets of equal width between its lowest and highest
    value, sums the buckets up (at most ``_BUCKETS`` + 1 rows a group) and keeps the one that holds
    the rank, until no group has too many values left. The lowest and the highest value never
    share a bucket, so every round leaves fewer.
    """
    placed = placed.withColumn("_for", F.explode(F.array(F.lit("low"), F.lit("high"))))
    groups = [*groups, "_for"]
    rank = F.when(F.col("_for") == "low", low).otherwise(high)
    while True:
        placed = written(placed.groupBy(*groups, "_w").agg(F.sum("_c").alias("_c")), "bracket")
        # Only distinct values count; the row of what lies below has none.
        spans = placed.groupBy(*groups).agg(F.min("_w").alias("_lo"), F.max("_w").alias("_hi"), F.count("_w").alias("_m"))
        if (spans.agg(F.max("_m")).first()[0] or 0) <= RANKED:
            return placed
        near = null_safe_join(placed, spans, groups)
        # Halves, because the whole width may be beyond a double.
        width = F.col("_hi") / 2 - F.col("_lo") / 2
        share = F.when(width > 0, (F.col("_w") / 2 - F.col("_lo") / 2) / width).otherwise(0.0)
        bucket = F.when(F.col("_w") == F.col("_hi"), _BUCKETS - 1).otherwise(F.least(F.floor(share * _BUCKETS), F.lit(_BUCKETS - 2)))
        marked = near.select(*groups, "_w", "_c", F.when(F.col("_w").isNull(), -1).when(F.col("_w") == F.col("_lo"), 0).otherwise(bucket).alias("_bucket"))
        along = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = marked.groupBy(*groups, "_bucket").agg(F.sum("_c").alias("_in")).withColumn("_upto", F.sum("_in").over(along))
        before = F.col("_upto") < rank
        holds = ~before & (F.col("_upto") - F.col("_in") < rank)
        kept = sums.where(before | holds).select(*groups, "_bucket", before.alias("_before"))
        placed = null_safe_join(marked, kept, [*groups, "_bucket"]).select(*groups, F.when(~F.col("_before"), F.col("_w")).alias("_w"), "_c")


def quantile_target(p: float) -> tuple[float, Column, Column]:
    pos = (F.col("_n") - 1) * F.lit(p)
    return p, F.floor(pos) + 1, F.ceil(pos) + 1


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, names: dict[str, float], extra: dict[str, Column] | None = None
) -> DataFrame:
    """Linearly interpolated quantiles: one column per entry of ``names``, the extras, and ``_n``."""
    more = extra or {}
    stats = order_statistics(
        df, keys, value, [quantile_target(p) for p in names.values()], extra=[c.alias(n) for n, c in more.items()], extra_names=list(more)
    )
    cols = []
    for i, (name, p) in enumerate(names.items()):
        at = F.col("_at")[i]
        pos = (F.col("_n") - 1) * F.lit(p)
        cols.append((at["low"] + (at["high"] - at["low"]) * (pos - F.floor(pos))).alias(name))
    return stats.select(*keys, *more, "_n", *cols)


def trimmed_mean(df: DataFrame, keys: Sequence[str], value: str, ratio: float = 0.15, min_rows: int = 6) -> DataFrame:
    """Mean after dropping the lowest and highest ``ratio`` of rows; small groups stay whole."""
    cut = F.when(F.col("_n") < min_rows, F.lit(0)).otherwise(F.floor(F.col("_n") * ratio))
    stats = order_statistics(
        df, keys, value,
        [(ratio, cut + 1, cut + 1), (1 - ratio, F.col("_n") - cut, F.col("_n") - cut)],
        # Untrimmed small groups need their extremes; their brackets span the whole range anyway.
    ).select(
        *keys, "_n", cut.alias("_cut"),
        F.col("_at")[0]["low"].alias("_lo"), F.col("_at")[0]["low_upto"].alias("_lo_upto"),
        F.col("_at")[1]["low"].alias("_hi"), F.col("_at")[1]["low_below"].alias("_hi_below"),
    )
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    joined = null_safe_join(rows, stats, keys)
    inside = F.when((F.col("_v") > F.col("_lo")) & (F.col("_v") < F.col("_hi")), F.col("_v"))
    kept = F.col("_n") - 2 * F.col("_cut")
    edge = F.col("_lo") * (F.col("_lo_upto") - F.col("_cut")) + F.col("_hi") * (
        F.col("_n") - F.col("_cut") - F.col("_hi_below")
    )
    return (
        joined.groupBy(*keys, "_n", "_cut", "_lo", "_hi", "_lo_upto", "_hi_below")
        .agg(F.coalesce(F.sum(inside), F.lit(0.0)).alias("_sum"))
        .select(
            *keys, F.col("_n").alias("n"), kept.alias("kept"),
            F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((F.col("_sum") + edge) / kept).alias("trimmed_mean"),
        )
    )
