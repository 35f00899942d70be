"""Snapshots into state: change detection, per-column merge policies, cleaning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from marketlens import catalog
from marketlens.functions import scores, times, urls
from marketlens.functions.money import storage_label
from marketlens.functions.text import none_if_blank, squeeze, text_hash
from marketlens.functions.titles import detect_family
from marketlens.operators import joins, windows
from marketlens.operators.aggregates import change_counters
from marketlens.operators.filters import invalid_rows, is_console_name, rejected_listing
from marketlens.operators.ordering import null_safe_join, previous_row
from marketlens.operators.similarity import nearest_price
from marketlens.plans import classify
from marketlens.session import settle, written


@dataclass(frozen=True)
class Policy:
    """How stored columns follow an offer.

    ``last``: the latest value; ``keep_if_null`` and ``keep_if_blank``: the latest value that is
    set, else the stored one; ``once``: only written for new rows.
    """

    last: tuple[str, ...] = ()
    keep_if_null: tuple[str, ...] = ()
    keep_if_blank: tuple[str, ...] = ()
    once: tuple[str, ...] = ()


def _kind(price_changed: Column, avail_changed: Column) -> Column:
    return (
        F.when(price_changed & avail_changed, "both").when(price_changed, "price").when(avail_changed, "availability").otherwise("unchanged")
    )


def diff_offers(offers: DataFrame, state: DataFrame, keys: Sequence[str], order: str, price: str, available: str | None) -> DataFrame:
    """Every offer's keys, order and values, the values before it and its ``change_type``.

    An offer is compared with the one before it in the batch, the first of a key with the
    stored state. Null against null is no change.
    """
    values = [price] + ([available] if available else [])
    # The scan writes what it is given, so it gets no other columns.
    seq = previous_row(offers.select(*keys, order, *values), keys, [order], values)
    stored = state.select(*keys, F.lit(True).alias("_stored"), *[F.col(v).alias(f"_old_{v}") for v in values])
    # One row per key on either side: only a key's first offer meets the stored row.
    first = null_safe_join(seq.where(~F.col("has_prev")), stored, keys, "left")
    later = seq.where(F.col("has_prev"))
    for v in values:
        first = first.withColumn(f"prev_{v}", F.col(f"_old_{v}")).drop(f"_old_{v}")
    first = first.withColumn("is_new", F.col("_stored").isNull()).drop("_stored")
    both = first.unionByName(later.withColumn("is_new", F.lit(False)))
    price_changed = ~F.col(price).eqNullSafe(F.col(f"prev_{price}"))
    avail_changed = ~F.col(available).eqNullSafe(F.col(f"prev_{available}")) if available else F.lit(False)
    return both.withColumn("change_type", F.when(F.col("is_new"), "new").otherwise(_kind(price_changed, avail_changed))).drop("has_prev")


def fold_offers(offers: DataFrame, keys: Sequence[str], order: str, policy: Policy, extra: Sequence[Column] = ()) -> DataFrame:
    """What a batch leaves per key; copies of a key combine before the shuffle."""
    o = F.col(order)
    kept = lambda c, test: F.max_by(c, F.when(test, o)).alias(c)
    packed = [("_last", F.max_by, policy.last), ("_once", F.min_by, policy.once)]
    folded = offers.groupBy(*keys).agg(
        F.min(order).alias("_first"),
        *[by(F.struct(*cols), o).alias(name) for name, by, cols in packed if cols],
        *[kept(c, F.col(c).isNotNull()) for c in policy.keep_if_null],
        *[kept(c, F.coalesce(F.col(c), F.lit("")) != "") for c in policy.keep_if_blank],
        *extra,
    )
    opened = [F.col(name)[c].alias(c) for name, _, cols in packed for c in cols]
    return folded.select("*", *opened).drop("_last", "_once")


def fresh_ids(state: DataFrame, folded: DataFrame, keys: Sequence[str], top: Column | None = None) -> DataFrame:
    """Keys of the batch that are not stored, with new ids in order of first sight after ``top``, by default the largest id of ``state``."""
    # Only keys and first positions are sorted and numbered; the rest of a row joins its number.
    unseen = null_safe_join(folded.select(*keys, "_first"), state.select(*keys), keys, "left_anti")
    return joins.next_ids(unseen, state, [F.col("_first"), *[F.col(k) for k in keys]], top=top).select(*keys, "id")


def known_ids(state: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and ids after a batch, without the work that the other columns of the state need."""
    return state.select(*keys, "id").unionByName(fresh)


def merge_state(state: DataFrame, folded: DataFrame, keys: Sequence[str], policy: Policy, as_of: Column, fresh: DataFrame) -> DataFrame:
    """Stored rows with the batch applied, and new rows under their ``fresh`` ids. ``touched`` marks rows in the batch."""
    marked = folded.withColumn("_in", F.lit(True))
    cols = [c for c in state.columns if c not in ("id", *keys, "first_seen", "last_seen")]
    joined = null_safe_join(state, marked.select(*keys, "_in", *[F.col(c).alias(f"_b_{c}") for c in cols if c in folded.columns]), keys, "left")
    hit = F.coalesce(F.col("_in"), F.lit(False))
    updated = []
    for c in cols:
        if c in policy.last:
            updated.append(F.when(hit, F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c))
        elif c in policy.keep_if_null or c in policy.keep_if_blank:
            updated.append(F.coalesce(F.col(f"_b_{c}"), F.col(c)).alias(c))
        else:
            updated.append(F.col(c))
    old = joined.select("id", *keys, *updated, "first_seen", F.when(hit, as_of).otherwise(F.col("last_seen")).alias("last_seen"), hit.alias("touched"))
    numbered = null_safe_join(marked, fresh, keys)
    fill = [F.col(c) if c in folded.columns else F.lit(None).cast(state.schema[c].dataType).alias(c) for c in cols]
    new = numbered.select("id", *keys, *fill, as_of.alias("first_seen"), as_of.alias("last_seen"), F.lit(True).alias("touched"))
    return old.unionByName(new)


def change_rows(diffed: DataFrame, known: DataFrame, keys: Sequence[str], order: str, price: str, available: str | None, as_of: Column, fk: str) -> DataFrame:
    """Change-log rows of a batch; ``known`` has the id of every key. A key with many changes is the many side of this join."""
    changed = diffed.where(F.col("change_type") != "unchanged").drop(fk)
    with_id = null_safe_join(changed, known.select(*keys, F.col("id").alias(fk)), keys)
    avail = [F.col(f"prev_{available}").alias("available_old"), F.col(available).alias("available_new")] if available else []
    return with_id.select(
        fk, order, as_of.alias("changed_at"), F.col(f"prev_{price}").alias("price_old"), F.col(price).alias("price_new"), *avail, "change_type"
    )


PRODUCT_KEYS = ("source", "name", "condition")
PRODUCT_POLICY = Policy(
    last=("url", "image_url", "last_price", "last_available"),
    keep_if_null=("sku", "category", "storage_label"),
)


def clean_offers(offers: DataFrame) -> DataFrame:
    """Trimmed names, defaults for missing fields, rows without name or source dropped."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return offers.select(
        "pos", text("name").alias("name"), text("source").alias("source"),
        F.trim(F.coalesce(F.when(F.col("condition") != "", F.col("condition")), F.lit("N/D"))).alias("condition"),
        F.col("price").cast("double").alias("last_price"), F.coalesce(F.col("available").cast("int"), F.lit(1)).alias("last_available"),
        none_if_blank(F.col("sku")).alias("sku"), text("grade").alias("grade"),
        F.coalesce("url", F.lit("")).alias("url"), F.coalesce("image_url", F.lit("")).alias("image_url"),
        storage_label(F.col("name")).alias("storage_label"),
        scores.lookup(catalog.CATEGORY_OF_FAMILY, detect_family(F.col("name"))).alias("category"),
    ).where((F.col("name") != "") & (F.col("source") != ""))


def apply_offers(
    state: DataFrame, offers: DataFrame, as_of: Column, *, keys: Sequence[str] = PRODUCT_KEYS, policy: Policy = PRODUCT_POLICY, order: str = "pos",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State after a snapshot, its change rows, and counters.

    Rule columns are not touched here: they are functions of the name, see ``reclassify``.
    """
    diffed = diff_offers(offers, state, keys, order, "last_price", "last_available")
    folded = fold_offers(offers, keys, order, policy)
    fresh = fresh_ids(state, folded, keys)
    merged = merge_state(state, folded, keys, policy, as_of, fresh)
    changes = change_rows(diffed, known_ids(state, fresh, keys), keys, order, "last_price", "last_available", as_of, "product_id")
    return merged.drop("touched"), changes, change_counters(diffed)


# --- listings and sold items: matched by id, then by address --------------------------------

def resolve_by_url(offers: DataFrame, state: DataFrame, id_col: str, order: str = "pos") -> DataFrame:
    """Adds ``entity``: the id under which the row is stored, or will be.

    A known id is itself. An unknown id takes over the stored row (lowest id) with the same
    address, or joins the first unknown id of the batch with that address. Offers, unknown ids
    and the result are written once each, for several steps read them.
    """
    offers = written(offers, "offers")
    known = state.select(F.col(id_col).alias("_known"))
    by_url = state.where(F.coalesce("url", F.lit("")) != "").groupBy(F.col("url").alias("_url")).agg(F.min_by(id_col, "id").alias("_stored"))
    ids = offers.where(F.col("url") != "").groupBy(id_col).agg(F.min_by("url", order).alias("_u"), F.min(order).alias("_o"))
    unknown = written(ids.join(known, ids[id_col] == F.col("_known"), "left_anti"), "unknown")
    leader = unknown.groupBy("_u").agg(F.min_by(id_col, "_o").alias("_leader"))
    taken = (
        unknown.join(leader, "_u").join(by_url, F.col("_u") == F.col("_url"), "left")
        .select(F.col(id_col).alias("_from"), F.coalesce("_stored", "_leader").alias("_entity"))
    )
    joined = offers.join(taken, offers[id_col] == F.col("_from"), "left")
    return written(joined.withColumn("entity", F.coalesce("_entity", id_col)).drop("_from", "_entity"), "resolved")


def _new_id(id_col: str, order: str) -> Column:
    """New id of a stored row that was found by its address: the last one in the batch."""
    return F.max_by(id_col, F.when(F.col("entity") != F.col(id_col), F.col(order))).alias("_new_id")


AD_POLICY = Policy(
    last=("image_url", "url", "seller_type", "last_price", "last_available"),
    keep_if_blank=("city", "region", "published_at", "body_text"),
    once=("name",),
)


def apply_ads(state: DataFrame, offers: DataFrame, as_of: Column, order: str = "pos") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Listings after a snapshot with their life cycle, change rows, counters.

    An available offer clears the sold fields; the first unavailable one sets them.
    """
    id_col, keys = "urn_id", ["entity"]
    seen = resolve_by_url(offers, state, id_col, order)
    stored = state.withColumn("entity", F.col(id_col))
    diffed = diff_offers(seen, stored, keys, order, "last_price", "last_available")
    told = [F.max("last_available").alias("_was_live"), F.max_by("name", order).alias("_last_name"), _new_id(id_col, order)]
    folded = fold_offers(seen, keys, order, AD_POLICY, told)
    # What the batch told besides the stored columns travels along, and so does the last sighting.
    carried = stored.drop(id_col).select(
        "*", F.lit(None).cast("int").alias("_was_live"), F.lit(None).cast("string").alias("_last_name"), F.lit(None).cast("string").alias("_new_id"),
        F.col("last_seen").alias("_prior_seen"),
    )
    policy = Policy(AD_POLICY.last + ("_was_live", "_last_name", "_new_id"), (), AD_POLICY.keep_if_blank, AD_POLICY.once)
    fresh = fresh_ids(carried, folded, keys)
    merged = merge_state(carried, folded, keys, policy, as_of, fresh)
    merged = merged.withColumn(id_col, F.coalesce("_new_id", "entity")).drop("_new_id")
    live = F.col("last_available") == 1
    touched = F.col("touched")
    # In one batch every step happens at ``as_of``: a row seen live before it ended was active just now.
    seen_live = F.coalesce(F.col("_was_live"), F.lit(0)) == 1
    is_new = touched & (F.col("first_seen") == as_of) & F.col("last_active_seen").isNull() & F.col("first_inactive_seen").isNull()
    active = F.when(seen_live, as_of).otherwise(F.col("last_active_seen"))
    inactive = F.when(seen_live, as_of).otherwise(F.coalesce("first_inactive_seen", as_of))
    start = F.when(seen_live, as_of).when(is_new, as_of).otherwise(F.coalesce("last_active_seen", "_prior_seen"))
    estimate_set = F.col("sold_at_estimated").isNotNull() & ~seen_live
    none_ts = F.lit(None).cast("timestamp")
    ended = touched & ~live

    def step(when_ended: Column, column: str, cleared: Column) -> Column:
        return F.when(ended, when_ended).when(touched, cleared).otherwise(F.col(column)).alias(column)

    out = merged.select(
        *[c for c in merged.columns if c not in ("last_active_seen", "first_inactive_seen", "sold_at", "sold_at_estimated", "sold_window_hours", "text_hash")],
        step(active, "last_active_seen", as_of), step(inactive, "first_inactive_seen", none_ts),
        step(F.when(seen_live, as_of).otherwise(F.coalesce("sold_at", as_of)), "sold_at", none_ts),
        step(F.when(estimate_set, F.col("sold_at_estimated")).otherwise(times.sold_estimate(start, inactive)), "sold_at_estimated", none_ts),
        step(F.when(estimate_set, F.col("sold_window_hours")).otherwise(times.sold_window_hours(start, inactive)), "sold_window_hours", F.lit(None).cast("double")),
        F.when(touched, text_hash(F.coalesce("_last_name", "name"), F.col("body_text"))).otherwise(F.col("text_hash")).alias("text_hash"),
    )
    changes = change_rows(diffed, known_ids(stored, fresh, keys), keys, order, "last_price", "last_available", as_of, "ad_id")
    return out.select(*state.columns), changes, change_counters(diffed)


SOLD_POLICY = Policy(last=("sold_price",), keep_if_blank=("url", "sold_date"), once=("name", "query_label"))


def apply_sold(state: DataFrame, offers: DataFrame, as_of: Column, order: str = "pos") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sold items after a snapshot; only price changes are logged, new rows are not."""
    id_col, keys = "item_id", ["entity"]
    seen = resolve_by_url(offers, state, id_col, order)
    stored = state.withColumn("entity", F.col(id_col))
    diffed = diff_offers(seen, stored, keys, order, "sold_price", None)
    folded = fold_offers(seen, keys, order, SOLD_POLICY, [_new_id(id_col, order)])
    carried = stored.drop(id_col).withColumn("_new_id", F.lit(None).cast("string"))
    policy = Policy(("sold_price", "_new_id"), (), SOLD_POLICY.keep_if_blank, SOLD_POLICY.once)
    fresh = fresh_ids(carried, folded, keys)
    merged = merge_state(carried, folded, keys, policy, as_of, fresh).withColumn(id_col, F.coalesce("_new_id", "entity"))
    changes = change_rows(diffed.where(F.col("change_type") != "new"), known_ids(stored, fresh, keys), keys, order, "sold_price", None, as_of, "item_id").drop("change_type")
    return merged.select(*state.columns), changes, change_counters(diffed)


# --- cleaning -----------------------------------------------------------------------------

def stale_rows(products: DataFrame, sources: Sequence[str] | DataFrame | None = None, separate: Sequence[str] = catalog.SEPARATE_SOURCES) -> DataFrame:
    """Adds ``stale``: not seen in the newest scrape of the source.

    ``sources`` limits it to some sources, given by name or as a table of one row per source.
    """
    newest = products.groupBy("source").agg(F.max("last_seen").alias("_newest"))
    key = F.lower(F.trim(F.coalesce("source", F.lit(""))))
    subject = (key != "") & ~key.isin(*separate)
    joined = null_safe_join(products, newest, ["source"], "left")
    if isinstance(sources, DataFrame):
        seen = sources.select(F.lower(F.trim("source")).alias("_s")).distinct().withColumn("_asked", F.lit(True))
        joined = joined.withColumn("_s", key).join(seen, "_s", "left").drop("_s")
        subject = subject & F.coalesce("_asked", F.lit(False))
    elif sources is not None:
        subject = subject & key.isin(*sources)
    return joined.withColumn("stale", subject & F.coalesce(F.col("last_seen") < F.col("_newest"), F.lit(False))).drop("_newest", "_asked")


def prune_stale(products: DataFrame, changes: DataFrame, fk: str = "product_id", sources: Sequence[str] | DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    kept = stale_rows(products, sources).where(~F.col("stale")).drop("stale")
    return kept, joins.drop_orphans(changes, kept, fk)


def count_stale(products: DataFrame) -> DataFrame:
    return stale_rows(products).where(F.col("stale")).groupBy("source").agg(F.count("*").alias("stale_rows"))


def reclassify(products: DataFrame, rules=None, taxonomy: DataFrame | None = None) -> DataFrame:
    """Every column that is a function of the name, computed afresh."""
    rules = rules or catalog.CONSOLE_RULES
    columns = products.columns
    out = classify.search_attributes(classify.standardize_titles(classify.classify_titles(products, "name", None, rules, taxonomy), "name", rules), "name", rules)
    grade = F.col("grade") if "grade" in columns else F.lit("")
    out = out.withColumn("packaging_state", scores.packaging_state(F.col("source"), F.col("name"), grade))
    base = (F.col("model_segment") == "base") & (F.col("edition_class") == "standard")
    return out.withColumn("is_base_model_auto", base.cast("int")).drop("label")


def force_conditions(products: DataFrame, desired: Column) -> tuple[DataFrame, DataFrame]:
    """Sets the condition; rows that then share source, name and condition become one.

    The row that already had the condition survives, else the lowest id. Second result: id map.
    """
    want = F.coalesce(desired, F.col("condition"))
    keyed = products.withColumn("_had", (F.col("condition") == want).cast("int")).withColumn("condition", want)
    special = ("id", "source", "name", "condition", "is_base_model", "is_base_model_auto", "first_seen", "last_seen")
    merged, moved = windows.fold_rows(
        keyed, ["source", "name", "condition"], ["_had", -F.col("id")], ["last_seen", F.col("_had"), -F.col("id")],
        newest=[c for c in products.columns if c in windows.PRODUCT_NEWEST],
        any_flag=[c for c in ("is_base_model", "is_base_model_auto") if c in products.columns], earliest=["first_seen"], last=["last_seen"],
        own=[c for c in products.columns if c not in windows.PRODUCT_NEWEST and c not in special],
    )
    return merged.select(*products.columns), moved


def normalize_conditions(products: DataFrame, defaults: dict[str, str] = catalog.SOURCE_CONDITION) -> tuple[DataFrame, DataFrame]:
    return force_conditions(products, scores.lookup(defaults, F.col("source")))


def normalize_marker_source(products: DataFrame, source: str = catalog.MARKER_SOURCE) -> tuple[DataFrame, DataFrame]:
    """One row per address, then the condition told by markers in name or address."""
    by_url, moved = windows.dedupe_by_url(products, [source])
    marked = F.when(F.col("source") == source, urls.condition_from_markers(F.col("name"), F.col("url")))
    out, moved2 = force_conditions(by_url, marked)
    return out, chain_moves(moved, moved2)


def chain_moves(first: DataFrame, second: DataFrame) -> DataFrame:
    """Old id to final id over two rounds of merging."""
    hop = second.select(F.col("old_id").alias("_o"), F.col("new_id").alias("_n"))
    through = first.join(hop, F.col("new_id") == F.col("_o"), "left").select("old_id", F.coalesce("_n", "new_id").alias("new_id"))
    return through.unionByName(second.join(first.select("old_id"), "old_id", "left_anti"))


def normalize_variant_source(products: DataFrame, changes: DataFrame, source: str = catalog.VARIANT_SOURCE, fk: str = "product_id") -> tuple[DataFrame, DataFrame]:
    """Drops rows of the source that are no consoles, and merges rows without a grade into the
    variant of the same address with the nearest price."""
    of_source = F.col("source") == source
    drop = of_source & ~is_console_name(F.coalesce("name", F.lit("")))
    kept = products.where(~F.coalesce(drop, F.lit(False)))
    keyed = kept.where(of_source).withColumn("_url", urls.simple_url(F.col("url"))).where(F.col("_url") != "")
    graded = F.coalesce("name", F.lit("")).rlike("(?iU)" + catalog.GRADE_SUFFIX)
    moves = nearest_price(keyed.where(~graded), keyed.where(graded), "_url", "last_price")
    moved = moves.select(F.col("legacy_id").alias("old_id"), F.col("keep_id").alias("new_id"))
    grouped = kept.join(moved, F.col("id") == F.col("old_id"), "left").withColumn("_to", F.coalesce("new_id", "id")).drop("old_id", "new_id")
    special = ("id", "is_base_model", "is_base_model_auto", "first_seen", "last_seen")
    merged, _ = windows.fold_rows(
        grouped.withColumn("_own", (F.col("_to") == F.col("id")).cast("int")), ["_to"], ["_own"], ["last_seen", "_own", -F.col("id")],
        newest=[c for c in products.columns if c in windows.PRODUCT_NEWEST],
        any_flag=[c for c in ("is_base_model", "is_base_model_auto") if c in products.columns], earliest=["first_seen"], last=["last_seen"],
        own=[c for c in products.columns if c not in windows.PRODUCT_NEWEST and c not in special],
    )
    out = merged.select(*products.columns)
    return out, joins.drop_orphans(windows.repoint(changes, moved, fk), out, fk)


def clean_catalog(products: DataFrame, changes: DataFrame, rules=None, taxonomy: DataFrame | None = None, fk: str = "product_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole clean-up in order, and a table of how many rows each step removed.

    Every merge uses its input several times, so each step is written once before the next.
    """
    steps: list[tuple[str, DataFrame, DataFrame]] = []
    own = products.where(~F.lower(F.trim(F.coalesce("source", F.lit("")))).isin(*catalog.SEPARATE_SOURCES))
    steps.append(("removed_separate_sources", products, own))
    bad = invalid_rows(own, ["name", "source", "condition"])
    valid = settle(own.join(bad.select(F.col("id").alias("_bad")), own["id"] == F.col("_bad"), "left_anti"))
    steps.append(("removed_invalid_rows", own, valid))
    log = joins.drop_orphans(changes, valid, fk)
    current, moved = normalize_conditions(valid)
    log = windows.repoint(log, moved, fk)
    current = settle(reclassify(current, rules, taxonomy))
    steps.append(("merged_by_condition", valid, current))
    deduped, moved = windows.dedupe_by_url(current)
    log, deduped = windows.repoint(log, moved, fk), settle(deduped)
    marked, moved = normalize_marker_source(deduped)
    log, marked = settle(windows.repoint(log, moved, fk)), settle(marked)
    variants, log = normalize_variant_source(marked, log, fk=fk)
    variants = settle(variants)
    steps.append(("url_merged_rows", current, variants))
    pruned, log = prune_stale(variants, log, fk)
    steps.append(("removed_stale", variants, pruned))
    summary = None
    for name, before, after in steps:
        one = before.agg(F.count("*").alias("_b")).select(F.lit(name).alias("step"), (F.col("_b") - after.agg(F.count("*")).scalar()).alias("rows"))
        summary = one if summary is None else summary.unionByName(one)
    return windows.display_ids(pruned), log, summary


def process_snapshot(
    products: DataFrame, changes: DataFrame, raw: DataFrame, as_of: Column, rules=None, taxonomy: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A store snapshot from raw offers to the numbered catalogue.

    Offers are cleaned and applied, every name is classified, the special sources are put in
    order, and products missing from the newest scrape of the sources seen leave with their
    history. Result: products, change log, counters; those of the offers and ``removed_stale``, the
    products that left.
    """
    offers = settle(clean_offers(raw))
    state, fresh, counters = apply_offers(products, offers, as_of)
    log = settle(changes.unionByName(fresh.select("product_id", "changed_at", "price_old", "price_new", "available_old", "available_new", "change_type")))
    state = settle(reclassify(state, rules, taxonomy))
    marked, moved = normalize_marker_source(state)
    marked, log = settle(marked), settle(windows.repoint(log, moved, "product_id"))
    variants, log = normalize_variant_source(marked, log)
    marked = settle(stale_rows(settle(variants), offers.select("source").distinct()))
    kept = marked.where(~F.col("stale")).drop("stale")
    counters = counters.withColumn("removed_stale", marked.agg(F.count_if("stale")).scalar())
    return windows.display_ids(kept), joins.drop_orphans(log, kept, "product_id"), counters


def refilter(ads: DataFrame, block: str, allow: str, floors: dict[str, float] = catalog.PRICE_FLOORS) -> DataFrame:
    """Rejected listings become unavailable; no change row, no sale date."""
    bad = rejected_listing(F.col("name"), F.col("console_family"), F.col("last_price"), block, allow, floors)
    return ads.withColumn("last_available", F.when((F.col("last_available") == 1) & bad, 0).otherwise(F.col("last_available")))


def set_values(df: DataFrame, updates: DataFrame, key: str, column: str, allowed: Sequence | None = None) -> tuple[DataFrame, DataFrame]:
    """Keyed updates (``key``, ``value``): the new rows, and per update whether it was applied."""
    value = F.col("value")
    legal = updates if allowed is None else updates.where(value.isin(*allowed))
    one = legal.groupBy(F.col(key).alias("_k")).agg(F.max("value").alias("_v"))
    out = df.join(one, df[key] == F.col("_k"), "left").withColumn(column, F.coalesce("_v", column)).drop("_k", "_v")
    known = df.select(F.col(key).alias("_id"))
    report = updates.join(known, updates[key] == F.col("_id"), "left").select(
        key, "value", (F.col("_id").isNotNull() & (F.lit(True) if allowed is None else value.isin(*allowed))).alias("applied")
    )
    return out, report


def backfill(state: DataFrame, steps: Sequence[tuple[int, str, object]], applied: Sequence[int] = ()) -> tuple[DataFrame, list[tuple[int, str]]]:
    """Ordered column back-fills; a version that was applied before is skipped."""
    done: list[tuple[int, str]] = []
    for version, name, step in sorted(steps, key=lambda s: s[0]):
        if version not in applied:
            state = step(state)
            done.append((version, name))
    return state, done


def add_missing(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns that are absent are added with their type and default."""
    for name, (kind, default) in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(kind))
    return df


def lifecycle_backfill(ads: DataFrame, legacy_version: str = "legacy") -> DataFrame:
    """Defaults for life-cycle columns of rows written before they existed."""
    sold = F.col("sold_at").isNotNull()
    live = (F.col("last_available") == 1) & ~sold
    return (
        ads.withColumn("classify_version", F.coalesce(none_if_blank(F.col("classify_version")), F.lit(legacy_version)))
        .withColumn("last_active_seen", F.coalesce("last_active_seen", F.when(live, F.col("last_seen"))))
        .withColumn("first_inactive_seen", F.coalesce("first_inactive_seen", "sold_at"))
        .withColumn("sold_at_estimated", F.coalesce("sold_at_estimated", "sold_at"))
        .withColumn("sold_window_hours", F.coalesce("sold_window_hours", F.when(sold, F.lit(0.0))))
        .withColumn("text_hash", text_hash(F.col("name"), squeeze(F.col("body_text"))))
    )
