"""Model scoring in steps, human review, and writing results back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketlens import catalog
from marketlens.catalog import CONSOLE_RULES, TitleRules
from marketlens.functions import scores
from marketlens.functions.text import shorten
from marketlens.operators import joins

Scorer = Callable[[DataFrame], DataFrame]

ATTEMPT_SCHEMA = (
    "taxonomy_id string, confidence string, object_type string, price_signal string, decision_reason string"
)


def parse_attempt(payload: Column) -> Column:
    return F.from_json(payload, ATTEMPT_SCHEMA)


def normalize_attempt(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Legal values only: confidence within 0..100, known labels, accessories count as ``other``."""
    ids = taxonomy.select(F.col("id").alias("_tid")).distinct()
    given = F.trim(F.coalesce("taxonomy_id", F.lit("other")))
    joined = df.join(ids, given == F.col("_tid"), "left")
    kind = scores.one_of(F.trim(F.col("object_type")), catalog.OBJECT_TYPES, "unknown")
    whole = F.trim(F.col("confidence").cast("string")).try_cast("double").cast("long")
    return joined.select(
        *[c for c in df.columns if c not in ("taxonomy_id", "confidence", "object_type", "price_signal", "decision_reason")],
        F.when(kind.isin(*catalog.NOT_CONSOLE), "other").otherwise(F.coalesce("_tid", F.lit("other"))).alias("taxonomy_id"),
        F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(whole, F.lit(0)))).cast("long").alias("confidence"),
        kind.alias("object_type"),
        scores.one_of(F.trim(F.col("price_signal")), catalog.PRICE_SIGNALS, "missing").alias("price_signal"),
        shorten(F.col("decision_reason"), 600).alias("decision_reason"),
    )


def salvage_json(text: Column) -> Column:
    """Scores from a model reply: fenced or bare JSON list, a wrapped list, else id and confidence pairs."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.trim(F.when(fenced != "", fenced).otherwise(text))
    item = "struct<id:long,console_confidence:long,family:string,model:string,sub_model:string,canonical:string,edition:string>"
    listed = F.when(body.startswith("["), F.from_json(body, f"array<{item}>"))
    wrapped = F.when(body.startswith("{"), F.from_json(body, f"struct<ads:array<{item}>,classifications:array<{item}>>"))
    pairs = r"(?is)[\"']?id[\"']?\s*:\s*(\d+).*?[\"']?console_confidence[\"']?\s*:\s*(\d+)"
    ids = F.regexp_extract_all(body, F.lit(pairs), 1)
    found = F.regexp_extract_all(body, F.lit(pairs), 2)
    loose = F.transform(
        F.arrays_zip(ids.alias("i"), found.alias("c")),
        lambda p: F.struct(
            p["i"].try_cast("long").alias("id"), p["c"].try_cast("long").alias("console_confidence"),
            *[F.lit(None).cast("string").alias(c) for c in ("family", "model", "sub_model", "canonical", "edition")],
        ),
    )
    strict = F.coalesce(listed, wrapped["ads"], wrapped["classifications"])
    return F.coalesce(F.filter(strict, lambda s: s["id"].isNotNull()), loose)


def price_bounds(df: DataFrame, taxonomy: DataFrame, id_col: str = "taxonomy_id") -> DataFrame:
    """Adds ``price_low`` and ``price_high`` of the catalogue row's price family."""
    family = scores.price_family(F.col("family"), F.col("model"))
    side = taxonomy.select(
        F.col("id").alias("_pid"),
        scores.lookup({k: v[0] for k, v in catalog.PRICE_BOUNDS.items()}, family).alias("price_low"),
        scores.lookup({k: v[1] for k, v in catalog.PRICE_BOUNDS.items()}, family).alias("price_high"),
    )
    return df.join(side, F.col(id_col) == F.col("_pid"), "left").drop("_pid")


def cascade(
    rows: DataFrame, scorers: Sequence[tuple[str, Scorer]], taxonomy: DataFrame, *, runs: DataFrame | None = None,
    threshold: int = catalog.CASCADE_THRESHOLD, with_bounds: Callable[[DataFrame, DataFrame], DataFrame] = price_bounds,
) -> tuple[DataFrame, DataFrame]:
    """Results and attempts of the scoring steps.

    ``rows`` has id, price and input_hash. A row with a finished run of the same hash takes
    that result. The others go from scorer to scorer until one is confident enough; each
    scorer adds taxonomy_id, confidence, object_type, price_signal and decision_reason.
    """
    if runs is None:
        fresh, reused = rows, None
    else:
        looked_up = joins.reuse_by_hash(rows, runs)
        fresh = looked_up.where(F.col("reused").isNull()).drop("reused")
        reused = looked_up.where(F.col("reused").isNotNull())
    waiting, attempts, done = fresh, [], []
    for step, (name, scorer) in enumerate(scorers, start=1):
        scored = normalize_attempt(scorer(waiting), taxonomy).withColumn("step_number", F.lit(step)).withColumn("model", F.lit(name))
        attempts.append(scored)
        enough = F.col("confidence") >= threshold
        last = step == len(scorers)
        done.append(scored if last else scored.where(enough))
        if not last:
            waiting = scored.where(~enough).select(*rows.columns)
    final = _union(done)
    bounded = with_bounds(final, taxonomy)
    conflict = scores.price_conflict(F.col("price"), F.col("price_low"), F.col("price_high"), F.col("price_signal")) & (F.col("taxonomy_id") != "other")
    status = scores.final_status(F.col("taxonomy_id"), F.col("confidence"), threshold, conflict)
    noted = F.when(conflict, shorten(F.concat("decision_reason", F.lit(" Price conflict detected by local validation.")), 600)).otherwise(F.col("decision_reason"))
    columns = ["id", "input_hash", "price", "taxonomy_id", "confidence", "object_type", "price_signal", "decision_reason", "status", "selected_model", "steps"]
    results = bounded.withColumn("status", status).withColumn("decision_reason", noted).withColumn("selected_model", F.col("model")).withColumn(
        "steps", F.col("step_number")
    ).select(*columns)
    log = _union(attempts).select("id", "step_number", "model", "taxonomy_id", "confidence", "object_type", "price_signal", "decision_reason")
    if reused is not None:
        known = F.coalesce("reused.taxonomy_id_final", F.lit("other"))
        again = reused.select(
            "id", "input_hash", "price", known.alias("taxonomy_id"), F.coalesce("reused.confidence_final", F.lit(0)).cast("long").alias("confidence"),
            F.when(known == "other", "unknown").otherwise("console").alias("object_type"), F.lit("compatible").alias("price_signal"),
            F.lit("Reused previous cascade classification for identical input hash.").alias("decision_reason"),
            F.coalesce("reused.status_final", F.lit("pending_review")).alias("status"), F.coalesce("reused.selected_model", F.lit("reuse")).alias("selected_model"),
            F.lit(1).alias("steps"),
        )
        results = results.unionByName(again)
        log = log.unionByName(again.select(
            "id", F.lit(1).alias("step_number"), F.lit("reuse").alias("model"), "taxonomy_id", "confidence", "object_type", "price_signal", "decision_reason"
        ))
    return results, log


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def run_audit(results: DataFrame, runs: DataFrame, as_of: Column, prompt: str, taxonomy_version: str) -> DataFrame:
    """Rows for the table of runs, numbered after the existing ones."""
    fresh = results.select(
        F.col("id").alias("ad_id"), "input_hash", F.lit(taxonomy_version).alias("taxonomy_version"), F.lit(prompt).alias("prompt_version"),
        F.col("status").alias("status_final"), F.col("taxonomy_id").alias("taxonomy_id_final"), F.col("confidence").alias("confidence_final"),
        "selected_model", as_of.alias("created_at"),
    )
    return joins.next_ids(fresh, runs, [F.col("ad_id")])


def apply_classification(
    state: DataFrame, results: DataFrame, taxonomy: DataFrame, *, prompt: str, sold: bool = False, rules: TitleRules = CONSOLE_RULES
) -> DataFrame:
    """Writes results (one per id) into listings, or into sold items."""
    mapped = joins.fields_of(results, taxonomy, "taxonomy_id", rules)
    method = F.concat(F.lit("ai-cascade:"), "selected_model", F.concat(F.lit(":"), "status") if sold else F.lit(""))
    new = {
        "console_family": F.col("console_family"), "sub_model": F.col("sub_model"), "model_segment": F.col("model_segment"),
        "edition_class": F.col("edition_class"), "canonical_model": F.col("canonical_model"), "classify_method": method,
        "classify_confidence": F.col("confidence") / 100.0,
    }
    if not sold:
        new |= {
            "ai_status": F.col("status"), "ai_confidence": F.col("confidence").cast("double"), "ai_taxonomy_id": F.col("taxonomy_id"),
            "ai_object_type": F.col("object_type"), "ai_price_signal": F.col("price_signal"), "ai_prompt_version": F.lit(prompt),
            "ai_input_hash": F.col("input_hash"), "classify_version": F.lit(prompt),
        }
    return write_back(state, mapped.select("id", *[v.alias(k) for k, v in new.items()]), list(new))


def write_back(state: DataFrame, updates: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replaces ``columns`` in the rows whose id is in ``updates`` (one row per id)."""
    side = updates.select(F.col("id").alias("_uid"), *[F.col(c).alias(f"_u_{c}") for c in columns])
    hit = F.col("_uid").isNotNull()
    joined = state.join(side, state["id"] == F.col("_uid"), "left")
    return joined.select(*[F.when(hit, F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in state.columns])


def apply_legacy_classification(
    state: DataFrame, results: DataFrame, *, families: Sequence[str], sub_models: Sequence[str], canonicals: Sequence[str], sold: bool = False
) -> DataFrame:
    """Single-step results: approved rows take the fields, rejected ones become ``other``, the rest only a confidence."""
    legal = lambda c, allowed: F.when(F.col(c).isin(*allowed), F.col(c))
    side = results.where(F.col("console_confidence").isNotNull()).select(
        F.col("id").alias("_rid"), F.col("console_confidence").alias("_conf"), legal("family", families).alias("_fam"),
        F.when(F.coalesce("model", "sub_model").isin(*sub_models), F.coalesce("model", "sub_model")).alias("_sub"),
        legal("canonical", canonicals).alias("_can"), legal("edition", catalog.EDITION_CLASSES).alias("_ed"),
    )
    joined = state.join(side, state["id"] == F.col("_rid"), "left")
    status = scores.legacy_status(F.col("_conf"))
    hit = F.col("_rid").isNotNull()
    approved = hit & (status == "approved") & F.col("_fam").isNotNull() & F.col("_can").isNotNull()
    rejected = hit & (status == "rejected")
    settled = approved | rejected
    rated = hit if sold else settled

    def pick(column: str, if_approved: Column, if_rejected: Column) -> Column:
        return F.when(approved, if_approved).when(rejected, if_rejected).otherwise(F.col(column))

    new = {
        "console_family": pick("console_family", F.col("_fam"), F.lit("other")),
        "sub_model": pick("sub_model", F.coalesce("_sub", "sub_model"), F.lit("Unknown")),
        "canonical_model": pick("canonical_model", F.col("_can"), F.lit("other")),
        "edition_class": F.when(approved, F.coalesce("_ed", "edition_class")).otherwise(F.col("edition_class")),
        "classify_method": F.when(rated, "ai:v1").otherwise(F.col("classify_method")),
        "classify_confidence": F.when(rated, F.col("_conf") / 100.0).otherwise(F.col("classify_confidence")),
    }
    if not sold:
        new |= {
            "ai_status": F.when(hit, status).otherwise(F.col("ai_status")),
            "ai_confidence": F.when(hit, F.col("_conf").cast("double")).otherwise(F.col("ai_confidence")),
        }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in state.columns])


def reset_ai_state(ads: DataFrame) -> DataFrame:
    return ads.withColumn("ai_status", F.lit("pending")).withColumn("ai_confidence", F.lit(None).cast("double"))


def apply_rule_results(state: DataFrame, results: DataFrame, version: str) -> DataFrame:
    columns = ["console_family", "model_segment", "edition_class", "canonical_model", "classify_confidence", "classify_method", "classify_version"]
    return write_back(state, results.withColumn("classify_version", F.lit(version)).select("id", *columns), columns)


def apply_review(
    state: DataFrame, reviews: DataFrame, runs: DataFrame, taxonomy: DataFrame, as_of: Column, rules: TitleRules = CONSOLE_RULES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State after human decisions, the audit rows, and the decisions that are not legal.

    ``reviews``: ad_id, human_taxonomy_id, human_status, review_reason, run_id, one per listing.
    """
    chosen = F.trim(F.coalesce("human_taxonomy_id", F.lit("")))
    ids = taxonomy.select(F.col("id").alias("_tid")).distinct()
    ads = state.select(F.col("id").alias("_aid"), F.col("ai_taxonomy_id"))
    given = F.coalesce("human_status", F.when(chosen == "other", "rejected_manual").otherwise("approved_manual"))
    joined = (
        reviews.withColumn("_chosen", chosen).withColumn("_status", given)
        .join(ids, F.col("_chosen") == F.col("_tid"), "left")
        .join(ads, F.col("ad_id") == F.col("_aid"), "left")
    )
    error = (
        F.when(F.col("_chosen") == "", "human_taxonomy_id required")
        .when(F.col("_tid").isNull() & (F.col("_chosen") != "other"), "invalid taxonomy_id")
        .when(~F.col("_status").isin("approved_manual", "rejected_manual"), "invalid human_status")
        .when(F.col("_aid").isNull(), "ad not found")
    )
    checked = joined.withColumn("error", error)
    good = checked.where(F.col("error").isNull())
    newest = runs.groupBy(F.col("ad_id").alias("_rad")).agg(F.max("id").alias("_run"))
    audit = good.join(newest, F.col("ad_id") == F.col("_rad"), "left").select(
        "ad_id", F.coalesce("run_id", "_run").alias("run_id"), "ai_taxonomy_id", F.col("_chosen").alias("human_taxonomy_id"),
        F.col("_status").alias("human_status"), F.coalesce("review_reason", F.lit("")).alias("review_reason"), as_of.alias("reviewed_at"),
    )
    updates = joins.fields_of(audit.select(F.col("ad_id").alias("id"), "human_taxonomy_id", "human_status"), taxonomy, "human_taxonomy_id", rules)
    new = {
        "ai_status": F.col("human_status"), "ai_taxonomy_id": F.col("human_taxonomy_id"), "console_family": F.col("console_family"),
        "sub_model": F.col("sub_model"), "model_segment": F.col("model_segment"), "edition_class": F.col("edition_class"),
        "canonical_model": F.col("canonical_model"), "classify_method": F.lit("human-review:v1"), "classify_confidence": F.lit(1.0),
    }
    if "ai_reviewed_at" in state.columns:
        new["ai_reviewed_at"] = as_of
    return write_back(state, updates.select("id", *[v.alias(k) for k, v in new.items()]), list(new)), audit, checked.where(F.col("error").isNotNull()).select("ad_id", "human_taxonomy_id", "error")
