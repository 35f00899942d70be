"""Joins between entities, dimensions, change logs and lookups."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketlens import catalog
from marketlens.catalog import CONSOLE_RULES, TitleRules
from marketlens.functions.scores import band_of_delta, deal_band, family_or_other, lookup, quality_band
from marketlens.functions.text import region_token
from marketlens.operators.ordering import null_safe_join, number_rows


def fixed_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of fixed values written in the code; its size is known here."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return spark.createDataFrame(pd.DataFrame(list(rows), columns=names, dtype="object"), schema)


def taxonomy_table(spark: SparkSession, rules: TitleRules = CONSOLE_RULES) -> DataFrame:
    """Catalogue rows with their rank, label and family key."""
    rows = [
        (i, e.id, rules.product, "Speciale" if e.special else "Canonico", e.family, e.model, e.memory, e.shell,
         f"{rules.label_prefix} {e.family} {e.model} {e.memory} - {e.shell}".replace(" Serie ", " Series "),
         rules.family_of_label.get(e.family.lower(), "other"))
        for i, e in enumerate(rules.catalogue)
    ]
    return fixed_table(
        spark, rows,
        "rank int, id string, product string, type string, family string, model string, memory string, "
        "shell string, label string, family_key string",
    )


def catalog_view(products: DataFrame, categories: DataFrame, storage: DataFrame) -> DataFrame:
    """Products with the names of their category and storage size."""
    cats = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    sizes = storage.select(F.col("id").alias("storage_id"), F.col("label").alias("storage_label"))
    return products.join(cats, "category_id", "left").join(sizes, "storage_id", "left")


def base_models(products: DataFrame, categories: DataFrame, storage: DataFrame) -> DataFrame:
    return catalog_view(products.where(F.col("is_base_model") == 1), categories, storage)


def with_taxonomy(df: DataFrame, taxonomy: DataFrame, ids: Sequence[str], prefix: str = "tax_") -> DataFrame:
    """Adds the catalogue columns of the first id that is set; ``taxonomy`` is a fixed table."""
    cols = [c for c in taxonomy.columns if c not in ("rank", "family_key")]
    side = taxonomy.select(*[F.col(c).alias(prefix + c) for c in cols])
    wanted = F.coalesce(*[F.when(F.trim(F.col(i)) != "", F.col(i)) for i in ids])
    return df.join(side, wanted == F.col(prefix + "id"), "left")


def changes_with_entity(changes: DataFrame, entities: DataFrame, fk: str, key: str = "id") -> DataFrame:
    return changes.join(entities, changes[fk] == entities[key], "inner")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key, by an aggregate that combines before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.struct(*[F.col(o) for o in order])).alias("_row")
    )
    return newest.select(*keys, *[F.col("_row")[c].alias(c) for c in others])


def pending_reviews(ads: DataFrame, runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Open listings awaiting review with their newest run, most confident first; all of them or the first ``limit``."""
    newest = runs.groupBy("ad_id").agg(
        F.max_by(F.struct(F.col("id").alias("run_id"), "selected_model", "created_at"), F.col("id")).alias("_run")
    )
    open_ads = ads.where(
        (F.col("ai_status") == "pending_review") & (F.col("last_available") == 1) & F.col("sold_at").isNull()
    )
    waiting = (
        open_ads.join(newest, open_ads["id"] == newest["ad_id"], "left")
        .select(*[open_ads[c] for c in ads.columns], "_run.run_id", "_run.selected_model", F.col("_run.created_at").alias("classified_at"))
        .orderBy(F.col("ai_confidence").desc_nulls_last(), F.col("id").desc())
    )
    return waiting if limit is None else waiting.limit(limit)


def drop_orphans(changes: DataFrame, entities: DataFrame, fk: str, key: str = "id") -> DataFrame:
    return changes.join(entities.select(F.col(key).alias("_k")), changes[fk] == F.col("_k"), "left_semi")


def orphans(changes: DataFrame, entities: DataFrame, fk: str, key: str = "id") -> DataFrame:
    return changes.join(entities.select(F.col(key).alias("_k")), changes[fk] == F.col("_k"), "left_anti")


def cascade_delete(entities: DataFrame, changes: DataFrame, ids: DataFrame, fk: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Entities and their change rows without the listed ids."""
    gone = ids.select(F.col(key).alias("_k")).distinct()
    return (
        entities.join(gone, entities[key] == F.col("_k"), "left_anti"),
        changes.join(gone, changes[fk] == F.col("_k"), "left_anti"),
    )


def common_columns(left: DataFrame, right: DataFrame, without: Sequence[str] = ("id",)) -> list[str]:
    there = set(right.columns)
    return [c for c in left.columns if c in there and c not in without]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key; copies collapse before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(
        F.min_by(F.struct(*others), F.struct(*[F.col(o) for o in order])).alias("_row")
    )
    return first.select(*keys, *[F.col("_row")[c].alias(c) for c in others]).select(*df.columns)


def next_ids(new_rows: DataFrame, existing: DataFrame, order: Sequence[Column], key: str = "id", out: str = "id", top: Column | None = None) -> DataFrame:
    """Numbers new rows after the largest existing id (``top`` if that is known), in ``order``."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).scalar() if top is None else top
    return number_rows(new_rows, order, out="_no").withColumn(out, top + F.col("_no")).drop("_no")


def insert_or_ignore(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is new, first occurrence of each."""
    fresh = first_per_key(incoming, keys, order)
    return null_safe_join(fresh, target.select(*keys).distinct(), keys, "left_anti")


def additive_merge(
    parents: DataFrame, incoming: DataFrame, keys: Sequence[str], children: DataFrame, incoming_children: DataFrame, fk: str
) -> tuple[DataFrame, DataFrame]:
    """New parents under fresh ids, and the children of just those parents.

    Returns the rows to append to each table, in the columns both sides share.
    """
    shared = common_columns(parents, incoming)
    fresh = insert_or_ignore(parents, incoming.select("id", *shared), keys, ["id"]).withColumnRenamed("id", "_from")
    # Only the old ids are sorted and numbered; they are unique.
    id_map = next_ids(fresh.select("_from"), parents, [F.col("_from")], out="_to")
    numbered = fresh.join(id_map, "_from").withColumnRenamed("_to", "id")
    kept = common_columns(children, incoming_children, without=("id", fk))
    kids = incoming_children.join(id_map, incoming_children[fk] == F.col("_from")).select(F.col("_to").alias(fk), *kept)
    return numbered.select("id", *shared), kids


def get_or_create_dim(dim: DataFrame, labels: DataFrame, label: str, order: str) -> DataFrame:
    """The dimension with unseen labels added under new ids, in order of first appearance."""
    seen = labels.where(F.col(label).isNotNull() & (F.col(label) != "")).groupBy(label).agg(F.min(order).alias("_first"))
    fresh = seen.join(dim.select(label), label, "left_anti")
    added = next_ids(fresh, dim, [F.col("_first"), F.col(label)]).select("id", label)
    return dim.select("id", label).unionByName(added)


def fallback_lookup(df: DataFrame, values: DataFrame, canonical: str, family: str, columns: Sequence[str]) -> DataFrame:
    """Value of the listing's model, else the best value of its family; others drop out.

    ``values`` has ``canonical_model``, ``fallback_family_key``, ``confidence``, ``sample_count``
    and ``key``. Best means most confident, then most samples, then first by family and key.
    """
    packed = F.struct(*columns)
    by_model = values.where(F.col("canonical_model").isNotNull()).select(
        F.col("canonical_model").alias("_m"), packed.alias("_by_model")
    )
    by_family = values.groupBy(F.col("fallback_family_key").alias("_f")).agg(
        F.min_by(packed, F.struct(-F.round("confidence", 3), -F.col("sample_count"), "console_family", "key")).alias("_by_family")
    )
    fam = F.coalesce(F.col(family), F.lit("other"))
    joined = df.join(by_model, F.col(canonical) == F.col("_m"), "left").join(by_family, fam == F.col("_f"), "left")
    hit = F.coalesce("_by_model", "_by_family")
    return joined.withColumn("_hit", hit).where(F.col("_hit").isNotNull()).select(
        *df.columns, *[F.col("_hit")[c].alias(c) for c in columns]
    )


def reuse_by_hash(
    rows: DataFrame, runs: DataFrame, statuses: Sequence[str] = ("approved_auto", "rejected_auto", "pending_review")
) -> DataFrame:
    """Newest finished run with the same input hash, if there is one."""
    newest = runs.where(F.col("status_final").isin(*statuses)).groupBy("input_hash").agg(
        F.max_by(
            F.struct("taxonomy_id_final", "confidence_final", "status_final", "selected_model", F.col("id").alias("run_id")),
            F.col("id"),
        ).alias("reused")
    )
    return rows.join(newest, "input_hash", "left")


def consistency_check(table: DataFrame, snapshot: DataFrame, separate: Sequence[str] = catalog.SEPARATE_SOURCES) -> DataFrame:
    """Rows per source in the table and in the latest snapshots, and whether they agree."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        source = F.lower(F.coalesce(F.col("source"), F.lit("")))
        kept = df.select(source.alias("source")).where((F.col("source") != "") & ~F.col("source").isin(*separate))
        return kept.groupBy("source").agg(F.count("*").alias(name))

    both = counted(table, "in_table").join(counted(snapshot, "in_snapshot"), "source", "full_outer")
    both = both.na.fill(0, ["in_table", "in_snapshot"])
    return both.withColumn("consistent", F.col("in_table") == F.col("in_snapshot"))


def overrides_table(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, catalog.OVERRIDES, "display_id long, fixed_storage string, fixed_color string, fixed_edition string")


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str = "display_id") -> DataFrame:
    """Manual storage, colour and edition per display id; ``overrides`` holds one row per id."""
    side = overrides.withColumnRenamed("display_id", "_o")
    joined = df.join(side, F.col(key) == F.col("_o"), "left").drop("_o")
    return joined.withColumn("storage_label", F.coalesce("fixed_storage", "storage_label")).drop("fixed_storage")


def opportunity_badges(ads: DataFrame, opportunities: DataFrame, averages: DataFrame) -> DataFrame:
    """Band from the scored opportunity, else from the family's average price."""
    opp = opportunities.select("id", F.col("delta_pct").alias("_delta"), F.col("quality_score").alias("_quality"))
    avg = averages.select("console_family", F.col("avg_price").alias("_avg"))
    avg = avg.withColumnRenamed("console_family", "_family")
    joined = ads.join(opp, "id", "left").join(avg, family_or_other() == F.col("_family"), "left")
    scored = F.col("_delta").isNotNull()
    return joined.select(
        *ads.columns,
        F.when(scored, band_of_delta(F.col("_delta"))).otherwise(
            F.coalesce(deal_band(F.col("last_price"), F.col("_avg")), F.lit("none"))
        ).alias("band"),
        F.when(scored, quality_band(F.col("_quality"))).alias("quality_band"),
    )


def entity_history(entities: DataFrame, changes: DataFrame, key: str, value: str, fk: str) -> DataFrame:
    """Changes of one entity, in time order."""
    one = entities.where(F.col(key) == value).select(F.col("id").alias("_id"), F.col("name"))
    return changes.join(one, changes[fk] == F.col("_id")).drop("_id").orderBy("changed_at", "id")


def attempts_of(attempts: DataFrame, ad_id) -> DataFrame:
    return attempts.where(F.col("ad_id") == ad_id).orderBy(F.col("run_id").desc(), F.col("step_number"))


def select_regions(requested: DataFrame, token: str, position: str, regions=catalog.REGIONS) -> DataFrame:
    """Requested regions by slug or label, each once, in order of first request.

    An unknown token fails the query.
    """
    spark = requested.sparkSession
    table = fixed_table(spark, regions, "label string, slug string")
    keyed = table.select("label", "slug", F.col("slug").alias("_key")).unionByName(
        table.select("label", "slug", region_token(F.col("label")).alias("_key"))
    ).distinct()
    wanted = requested.where(F.trim(F.col(token)) != "").withColumn("_key", region_token(F.col(token)))
    joined = wanted.join(F.broadcast(keyed), "_key", "left")
    known = F.when(F.col("slug").isNull(), F.raise_error(F.concat(F.lit("unknown region: "), F.col(token)))).otherwise(F.col("slug"))
    return (
        joined.select("label", known.cast("string").alias("slug"), position)
        .groupBy("label", "slug").agg(F.min(position).alias("first_position"))
        .orderBy("first_position")
    )


def unknown_regions(requested: DataFrame, token: str, regions=catalog.REGIONS) -> DataFrame:
    known = sorted({s for _, s in regions})
    slug_of_label = region_token(F.col(token))
    return requested.where((F.trim(F.col(token)) != "") & ~slug_of_label.isin(*known))


def fields_of(df: DataFrame, taxonomy: DataFrame, id_col: str, rules: TitleRules = CONSOLE_RULES) -> DataFrame:
    """Classification fields of a catalogue id; an unknown id counts as ``other``."""
    side = taxonomy.select(
        F.col("id").alias("_tid"), F.col("family_key"), F.col("model").alias("_model"), (F.col("type") == "Speciale").alias("_special")
    )
    joined = df.join(side, F.trim(F.col(id_col)) == F.col("_tid"), "left")
    known = F.col("_tid").isNotNull()
    sub = F.coalesce(lookup(rules.sub_models, F.lower(F.trim("_model"))) if rules.sub_models else F.lit(None), F.col("_model"))
    return joined.select(
        *df.columns,
        F.coalesce("family_key", F.lit("other")).alias("console_family"),
        F.when(known, sub).otherwise("Unknown").alias("sub_model"),
        F.when(known, F.when(F.col("_special"), "premium").otherwise("base")).otherwise("unknown").alias("model_segment"),
        F.when(F.col("_special"), "special").otherwise("standard").alias("edition_class"),
        F.coalesce("_tid", F.lit("other")).alias("canonical_model"),
    )
