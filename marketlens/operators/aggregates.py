"""Aggregations over listings, offers, change logs and jobs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from marketlens import catalog
from marketlens.functions import scores, times
from marketlens.functions.money import positive
from marketlens.functions.text import matches
from marketlens.operators.ordering import exact_quantiles, null_safe_join

_count = F.count


def flag(test: Column) -> Column:
    return F.coalesce(test.cast("int"), F.lit(0)).cast("long")


def ad_stats(ads: DataFrame) -> DataFrame:
    live = F.when((F.col("last_available") == 1) & (F.col("last_price") > 0), F.col("last_price"))
    return ads.agg(
        _count("*").alias("total"), F.sum(F.col("last_available").cast("long")).alias("available"),
        F.min(live).alias("min_price"), F.avg(live).alias("avg_price"),
    )


def _sold_measures(blank_is_null: bool) -> list[Column]:
    price = positive(F.col("last_price"))
    start = F.coalesce("published_at", "first_seen") if blank_is_null else F.when(
        F.col("published_at").isNull() & F.col("published_blank"), F.lit(None)
    ).otherwise(F.coalesce("published_at", "first_seen"))
    hours = times.hours_between(F.coalesce("sold_at_estimated", "sold_at"), start)
    return [
        _count("*").alias("total_sold"), F.avg(price).alias("avg_price"), F.min(price).alias("min_price"),
        F.max(price).alias("max_price"), F.avg(hours).alias("avg_hours_active"),
        F.avg("sold_window_hours").alias("avg_sold_window_hours"),
    ]


def sold_stats(ads: DataFrame, by: Sequence[str] = (), blank_is_null: bool = False) -> DataFrame:
    """Prices and time on sale of ended listings.

    A blank publication date (``published_blank``) takes the row out of the average time,
    unless ``blank_is_null`` lets the first sighting stand in.
    """
    if not blank_is_null and "published_blank" not in ads.columns:
        ads = ads.withColumn("published_blank", F.lit(False))
    sold = ads.where(F.col("sold_at").isNotNull())
    out = sold.groupBy(*by).agg(*_sold_measures(blank_is_null))
    return out.orderBy(F.col("total_sold").desc(), *by) if by else out


def _sold_moment() -> Column:
    return F.coalesce("sold_at_estimated", "sold_at")


def sold_by(ads: DataFrame, what: str) -> DataFrame:
    """Ended listings per ``weekday_idx`` (Sunday 0), ``hour`` or ``period`` of the day."""
    bucket = {
        "weekday_idx": times.weekday(_sold_moment()).cast("long"),
        "hour": F.hour(_sold_moment()).cast("long"),
        "period": times.day_period(F.hour(_sold_moment())),
    }[what]
    counted = ads.where(F.col("sold_at").isNotNull()).groupBy(bucket.alias(what)).agg(_count("*").alias("count"))
    return counted.orderBy(F.col("count").desc(), what)


def store_stats(items: DataFrame, by: str = "console_family", price: str = "sold_price") -> DataFrame:
    """Overall and per family in one pass; ``level`` 1 marks the overall row."""
    p = F.col(price)
    return items.rollup(by).agg(
        F.grouping(by).cast("long").alias("level"), _count("*").alias("count"), F.min(positive(p)).alias("min_price"),
        F.max(p).alias("max_price"), F.avg(positive(p)).alias("avg_price"),
    )


def price_summary(df: DataFrame, keys: Sequence[str], price: str) -> DataFrame:
    """Count, range, mean, exact quartiles and population deviation of positive prices."""
    rows = df.where(F.col(price) > 0)
    basic = rows.groupBy(*keys).agg(
        _count("*").alias("count"), F.min(price).alias("min"), F.max(price).alias("max"),
        F.avg(price).alias("avg"), F.stddev_pop(price).alias("stdev"),
    )
    quart = exact_quantiles(rows, keys, price, {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("_n")
    if not keys:
        one = quart.select(F.struct("q1", "median", "q3")).scalar()
        return basic.withColumn("_q", one).select(*basic.columns, *[F.col("_q")[c].alias(c) for c in ("q1", "median", "q3")])
    return null_safe_join(basic, quart, keys)


def standard_groups(products: DataFrame) -> DataFrame:
    """One row per standard key. Sets run over sources, packagings and conditions, all short lists.

    The items of a group are a table of their own, see ``standard_group_items``.
    """
    rows = _standard_rows(products)
    order = F.struct("source", "original_name", "condition", "id")
    clean = lambda c: F.when(F.col(c) != "", F.col(c))
    return (
        rows.groupBy("standard_key")
        .agg(
            F.min_by("standard_name", order).alias("standard_name"), _count("*").alias("total_products"),
            F.sort_array(F.collect_set(clean("source"))).alias("sources"),
            F.sort_array(F.collect_set(clean("packaging"))).alias("packaging_states"),
            F.sort_array(F.collect_set(clean("condition"))).alias("conditions"),
        )
        .orderBy(F.lower("standard_name"), F.col("total_products").desc(), "standard_key")
    )


def standard_group_items(products: DataFrame) -> DataFrame:
    return _standard_rows(products).select(
        "standard_key", "source", F.col("original_name").alias("name"), F.col("packaging").alias("packaging_state"), "condition"
    ).distinct()


def _standard_rows(products: DataFrame) -> DataFrame:
    def text(c: str) -> Column:
        return F.trim(F.coalesce(F.col(c), F.lit("")))

    name = F.coalesce(F.when(text("standard_name") != "", text("standard_name")), F.when(text("name") != "", text("name")), F.lit("N/D"))
    return products.select(
        "id", text("source").alias("source"), text("name").alias("original_name"), text("condition").alias("condition"),
        F.when(text("packaging_state") == "", "Imballata").otherwise(text("packaging_state")).alias("packaging"),
        name.alias("standard_name"),
        F.when(text("standard_key") != "", text("standard_key")).otherwise(F.concat(F.lit("name:"), F.lower(name))).alias("standard_key"),
    )


def search_groups(rows: DataFrame) -> DataFrame:
    """Search hits with their group's key, name and size; order gives the listing inside a group."""
    keyed = rows.withColumn("group_key", F.coalesce("standard_key", "standard_name", "name", F.lit("?")))
    groups = keyed.groupBy("group_key").agg(
        _count("*").alias("hits"), F.min(F.coalesce("last_price", F.lit(0.0))).alias("lowest"), F.min_by("standard_name", "id").alias("group_name")
    )
    return groups.orderBy("group_name", "group_key")


def filter_standard_groups(groups: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """Groups whose name, key or any item name contains ``text``."""
    needle = F.lit(text.lower().strip())
    by_item = items.where(F.contains(F.lower("name"), needle)).select("standard_key").distinct().withColumn("_hit", F.lit(True))
    joined = groups.join(by_item, "standard_key", "left")
    own = F.contains(F.lower("standard_name"), needle) | F.contains(F.lower("standard_key"), needle)
    return joined.where(own | F.col("_hit").isNotNull()).drop("_hit")


def family_average(ads: DataFrame, floor: float = 35.0) -> DataFrame:
    kept = ads.where((F.col("last_available") == 1) & (F.col("last_price") >= floor))
    return kept.groupBy(scores.family_or_other().alias("console_family")).agg(
        F.avg("last_price").alias("avg_price"), _count("*").alias("ads")
    )


def family_store_matrix(offers: DataFrame, stores: Sequence[str], family: str = "console_family") -> DataFrame:
    """Per family: available count, lowest price and total of each store, and reference prices."""
    live = F.col("available") == 1
    cells = []
    for store in stores:
        at = F.col("source") == store
        cells += [
            F.sum(flag(at & live)).alias(f"{store}_available"), F.min(F.when(at & live, F.col("price"))).alias(f"{store}_min_price"),
            F.sum(flag(at)).alias(f"{store}_total"),
        ]
    known = F.col("source").isin(*stores) & live
    return offers.groupBy(family).agg(
        *cells,
        F.avg(F.when(known & (F.col("condition") == "Usato"), F.col("price"))).alias("ref_used"),
        F.avg(F.when(known & (F.col("condition") == "Nuovo"), F.col("price"))).alias("ref_new"),
    )


def store_card_counts(offers: DataFrame, family: str = "console_family") -> DataFrame:
    """Available and total per store, and per store and family; ``level`` 0 is the finer one."""
    return (
        offers.rollup("source", family)
        .agg(F.grouping_id().cast("long").alias("level"), F.sum(flag(F.col("available") == 1)).alias("available"), _count("*").alias("total"))
        .where(F.col("level") < 3)
    )


def global_counts(offers: DataFrame, separate: Sequence[str] = catalog.SEPARATE_SOURCES) -> DataFrame:
    return offers.agg(
        _count("*").alias("total"), F.sum(flag(F.col("available") == 1)).alias("available"),
        F.count_distinct(F.when(~F.col("source").isin(*separate), F.col("source"))).alias("stores"),
    )


def deal_thresholds(products: DataFrame, vat: float = catalog.VAT_RATE, source: str = "cex") -> DataFrame:
    """Lowest net store price per family: of the favourite models, else of all."""
    rows = products.where((F.col("source") == source) & (F.col("last_price") > 0) & (F.col("last_available") == 1))
    favourite = F.min(F.when(F.col("is_base_model") == 1, F.col("last_price")))
    return rows.groupBy(scores.family_or_other().alias("console_family")).agg(
        (F.coalesce(favourite, F.min("last_price")) * (1 - vat)).alias("threshold")
    )


def daily_sold(rows: DataFrame, day: str, price: str, keys: Sequence[str] = ()) -> DataFrame:
    p = F.col(price)
    return rows.where(F.col(day).isNotNull()).groupBy(*keys, day).agg(
        _count("*").alias("count"), F.avg(positive(p)).alias("avg_price")
    )


def sold_dashboard(rows: DataFrame, day: str, price: str) -> DataFrame:
    days = daily_sold(rows, day, price)
    return days.agg(
        F.sum("count").alias("total"), _count("*").alias("days"), F.max("count").alias("peak_count"),
        F.max_by(F.col(day), F.struct("count", -F.unix_date(F.col(day)))).alias("peak_day"),
        (F.sum("count") / _count("*")).alias("avg_per_day"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
    )


def family_sold_series(rows: DataFrame, day: str, price: str, family: str = "console_family") -> DataFrame:
    """Per family: count, days with a sale, and the summary of prices; largest family first."""
    keyed = rows.withColumn("_fam", F.coalesce(family, F.lit("other")))
    counts = keyed.groupBy("_fam").agg(_count("*").alias("sold"), F.count_distinct(day).alias("active_days"))
    prices = price_summary(keyed, ["_fam"], price)
    return (
        null_safe_join(counts, prices, ["_fam"], "left").withColumnRenamed("_fam", family)
        .orderBy(F.col("sold").desc(), family)
    )


def edition_facets(products: DataFrame, column: str, generic=("standard", "limited", "special", "bundle", "")) -> DataFrame:
    value = F.trim(F.coalesce(F.col(column), F.lit("")))
    return (
        products.select(value.alias("edition")).where(~F.lower("edition").isin(*generic))
        .groupBy("edition").agg(_count("*").alias("count")).orderBy(F.col("count").desc(), "edition")
    )


def market_kpis(rows: DataFrame, group: Column, price: str) -> DataFrame:
    p = positive(F.col(price))
    return rows.agg(
        _count("*").alias("total"), F.count_distinct(F.when(group != "", group)).alias("groups"),
        F.min(p).alias("min_price"), F.avg(p).alias("avg_price"),
    )


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).where(F.coalesce(F.col(column), F.lit("")) != "").distinct().orderBy(column)


def selection_funnel(ads: DataFrame, statuses: Sequence[str], on_topic: Column) -> DataFrame:
    ok = F.col("ai_status").isin(*statuses)
    open_ok = ok & (F.col("last_available") == 1) & F.col("sold_at").isNull()
    counted = ads.agg(
        _count("*").alias("total_ads"), F.sum(flag(ok)).alias("status_ok"), F.sum(flag(open_ok)).alias("active_unsold"),
        F.sum(flag(open_ok & on_topic)).alias("topic_subset"),
    )
    return counted.withColumn("excluded_by_topic", F.col("active_unsold") - F.col("topic_subset"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(_count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def change_counters(diffed: DataFrame) -> DataFrame:
    """Counters over the outcome of every offer; ``both`` counts for price and availability."""
    kind = F.col("change_type")
    return diffed.agg(
        F.coalesce(F.sum(flag(kind == "new")), F.lit(0)).alias("new"),
        F.coalesce(F.sum(flag(kind.isin("price", "both"))), F.lit(0)).alias("price_changes"),
        F.coalesce(F.sum(flag(kind.isin("availability", "both"))), F.lit(0)).alias("avail_changes"),
        F.coalesce(F.sum(flag(kind == "unchanged")), F.lit(0)).alias("unchanged"),
    )


def run_summary(stats: DataFrame, order: Sequence[str] = catalog.STORE_ORDER) -> DataFrame:
    """Totals per source: stores in their fixed order, then the listing and sold sources."""
    ranks = {s: i for i, s in enumerate([*order, *catalog.SEPARATE_SOURCES])}
    rank = scores.lookup(ranks, F.col("source"))
    summed = stats.groupBy("source").agg(F.sum("total").alias("total"), F.sum("new").alias("new"))
    return summed.withColumn("rank", rank.cast("long")).where(F.col("rank").isNotNull()).orderBy("rank")


def reason_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("chunk", "reason").agg(_count("*").alias("count"))


def unstable_hits(reasons: DataFrame) -> DataFrame:
    return reasons.agg(
        F.coalesce(F.sum(F.when(scores.unstable_reason(F.col("reason")), F.col("count"))), F.lit(0)).alias("unstable_hits")
    )


def top_reasons(reasons: DataFrame, n: int = 8) -> DataFrame:
    total = reasons.groupBy("reason").agg(F.sum("count").alias("count"))
    return total.orderBy(F.col("count").desc(), "reason").limit(n)


def verification_summary(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Coverage and block ratios from verified outcomes: status, reason, new-sale price and hours."""
    verified = F.col("outcome").isin("active", "sold")
    reason = F.coalesce("reason", F.lit(""))

    def hits(test: Column) -> Column:
        return F.sum(flag(test))

    counted = outcomes.groupBy(*by).agg(
        _count("*").alias("attempted"), hits(verified).alias("verified"), hits(F.col("outcome") == "active").alias("active"),
        hits(F.col("new_sale")).alias("sold"), hits((F.col("outcome") == "sold") & ~F.col("new_sale")).alias("already_sold"),
        hits(F.col("recovered")).alias("recovered"), hits(~verified).alias("skipped"),
        hits(F.contains(reason, F.lit("http-403"))).alias("blocked_403"), hits(reason == "skipped:cffi-block").alias("blocked_precheck"),
        hits(reason.startswith("blocked:") | (reason == "skipped:cffi-block")).alias("blocked_total"),
        F.avg(F.when(F.col("new_sale") & (F.col("price") > 0), F.col("price"))).alias("avg_price_sold"),
        F.avg(F.when(F.col("new_sale") & (F.col("hours_active") >= 0), F.col("hours_active"))).alias("avg_hours_active"),
    )
    base = F.greatest(F.col("attempted"), F.lit(1))
    return counted.select(
        "*", (F.col("verified") / base).alias("coverage_ratio"), (F.col("blocked_403") / base).alias("blocked_403_ratio"),
        (F.col("blocked_total") / base).alias("blocked_total_ratio"),
    )


def job_status(jobs: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Newest run of every known job; ok turns to warn when it is older than twice the cadence.

    ``jobs`` has job, label, cadence_h; ``runs`` has id, job, status, ended_at, counts, error.
    """
    newest = runs.groupBy("job").agg(
        F.max_by(F.struct("status", "ended_at", "counts", "error"), F.col("id")).alias("_r")
    )
    joined = jobs.join(newest, "job", "left")
    recorded = scores.one_of(F.col("_r.status"), catalog.JOB_STATUS, "error")
    age = times.age_hours(F.col("_r.ended_at"), as_of)
    stale = (F.col("cadence_h") > 0) & (age > F.col("cadence_h") * 2) & (recorded == "ok")
    counters = scores.counts_text(F.col("_r.counts"))
    summary = F.coalesce(F.when(F.col("_r.error") != "", F.substring("_r.error", 1, 200)), F.when(counters != "", counters), F.lit("OK"))
    none = F.col("_r").isNull()
    return joined.select(
        "job", "label",
        F.when(none, "unknown").when(F.coalesce(stale, F.lit(False)), "warn").otherwise(recorded).alias("status"),
        F.col("_r.ended_at").alias("last_run"), age.alias("age_hours"),
        F.when(none, "no run recorded").otherwise(summary).alias("summary"),
    )


def overall_status(status: DataFrame) -> DataFrame:
    """Error beats warn beats ok; unknown jobs do not count."""
    bad = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    return status.agg(F.when(bad("error"), "error").when(bad("warn"), "warn").otherwise("ok").alias("overall"))


def job_log_status(lines: DataFrame, jobs: DataFrame, line_no: str = "line_no") -> DataFrame:
    """Outcome of each job's last run segment.

    ``lines`` has job, line and an ordering; ``jobs`` has job, cadence_h, age_h and the patterns
    error_re, problem_re, ok_re (null when absent). Order: job error, crash, problem, stale,
    confirmed, unconfirmed, transient issue, ok.
    """
    def hit(pattern: str, words: Sequence[str]) -> Column:
        # Few lines hold a word of the pattern, and only those are looked at a second time.
        holds = [F.contains(F.lower("line"), F.lit(w)) for w in words]
        return reduce(Column.__or__, holds) & F.col("line").rlike("(?i)" + pattern)

    def own(pattern: str) -> Column:
        return F.when(F.col(pattern).isNotNull(), F.regexp_like("line", F.concat(F.lit("(?i)"), F.col(pattern))))

    # What cannot decide a job's status is not looked for.
    old = F.coalesce(F.col("age_h") > F.col("cadence_h") * 2, F.lit(False))
    # A crash or stop marker lies within one line, so lines are tested one by one.
    marked = lines.join(jobs, "job").select(
        "job", line_no, F.trim("line").alias("_t"), own("error_re").alias("_error"), hit(catalog.LOG_FATAL, catalog.LOG_FATAL_WORDS).alias("_fatal"),
        own("problem_re").alias("_problem"), F.when(~old, own("ok_re")).alias("_ok"),
        F.when(~old & F.col("ok_re").isNull(), hit(catalog.LOG_ISSUE, catalog.LOG_ISSUE_WORDS)).alias("_issue"),
    )

    def first_line(test: str) -> Column:
        return F.min_by("_t", F.when(F.col(test), F.col(line_no)))

    def any_of(test: str) -> Column:
        return F.coalesce(F.bool_or(F.col(test)), F.lit(False))

    found = marked.groupBy("job").agg(
        *[any_of(c).alias(c) for c in ("_error", "_fatal", "_problem", "_ok", "_issue")],
        *[first_line(c).alias(f"{c}_line") for c in ("_error", "_fatal", "_problem", "_issue")],
        F.max_by("_t", F.when(F.col("_t") != "", F.col(line_no))).alias("_last"),
    )
    joined = jobs.join(found, "job", "left")
    seen = F.col("_fatal").isNotNull()
    stale = F.col("age_h") > F.col("cadence_h") * 2
    status = (
        F.when(~seen, "unknown").when(F.col("_error"), "error").when(F.col("_fatal"), "error").when(F.col("_problem"), "warn")
        .when(stale, "stale").when(F.col("ok_re").isNotNull(), F.when(F.col("_ok"), "ok").otherwise("warn"))
        .when(F.col("_issue"), "warn").otherwise("ok")
    )
    summary = (
        F.when(~seen, "no log").when(F.col("_error"), F.col("_error_line")).when(F.col("_fatal"), F.col("_fatal_line"))
        .when(F.col("_problem"), F.col("_problem_line")).when(stale, "stale")
        .when(F.col("ok_re").isNotNull() | ~F.col("_issue"), F.col("_last")).otherwise(F.col("_issue_line"))
    )
    return joined.select("job", status.alias("status"), F.substring(F.coalesce(summary, F.lit("")), 1, 200).alias("summary"))


def overall_log_status(status: DataFrame) -> DataFrame:
    rank = scores.lookup({"error": 0, "stale": 1, "warn": 2, "unknown": 3, "ok": 4}, F.col("status"))
    return status.agg(F.coalesce(F.min_by("status", rank), F.lit("ok")).alias("overall"))


def archived_runs(lines: DataFrame) -> DataFrame:
    """Newest numbered run of each folder: failed, ok or unknown. ``lines`` has folder, path, line."""
    numbered = lines.withColumn("run", F.regexp_extract("path", r"#(\d+)", 1).try_cast("long")).where(F.col("run").isNotNull())
    per_run = numbered.groupBy("folder", "run").agg(
        F.bool_or(F.col("line").rlike("(?i)" + catalog.LOG_RUN_FAILED)).alias("_failed"),
        F.bool_or(F.coalesce(F.trim("line"), F.lit("")) != "").alias("_text"),
    )
    newest = per_run.groupBy("folder").agg(
        F.max("run").alias("last_run"), _count("*").alias("runs"), F.max_by(F.struct("_failed", "_text"), "run").alias("_l")
    )
    status = F.when(F.coalesce("_l._failed", F.lit(False)), "error").when(F.col("_l._text"), "ok").otherwise("unknown")
    return newest.select("folder", "runs", "last_run", status.alias("status"))


def last_segment(lines: DataFrame, keys: Sequence[str], line_no: str, marker: str = catalog.LOG_SEGMENT) -> DataFrame:
    """Lines from the last start marker on; a log without one is kept whole."""
    start = lines.where(F.col("line").rlike(marker)).groupBy(*keys).agg(F.max(line_no).alias("_start"))
    joined = null_safe_join(lines, start, keys, "left")
    return joined.where(F.col("_start").isNull() | (F.col(line_no) >= F.col("_start"))).drop("_start")


def tail_lines(lines: DataFrame, keys: Sequence[str], line_no: str, n: int) -> DataFrame:
    """Last ``n`` lines of each log, at least 1.

    Line numbers without gaps give the tail from the largest one.
    """
    n = max(1, int(n))
    top = lines.groupBy(*keys).agg(F.max(line_no).alias("_top"))
    return null_safe_join(lines, top, keys).where(F.col(line_no) > F.col("_top") - n).drop("_top")


def job_history(runs: DataFrame, job: str, limit: int | None = None) -> DataFrame:
    """Runs of a job, newest first: all of them, or the newest ``limit`` (at least one)."""
    rows = runs.where(F.col("job") == job).orderBy(F.col("id").desc())
    return rows if limit is None else rows.limit(max(1, int(limit)))


def first_match(text: Column, pattern: str) -> Column:
    return F.when(matches(text, pattern), F.regexp_extract(text, "(?iU)(" + pattern + ")", 1))

