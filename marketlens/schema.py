"""Column types of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_RULES = (
    "console_family string, sub_model string, model_segment string, edition_class string, canonical_model string, "
    "classify_confidence double, classify_method string"
)

TABLES = {
    "products": (
        "id long, source string, name string, condition string, display_id long, sku string, category string, storage_label string, "
        f"{_RULES}, standard_name string, standard_key string, edition_name string, color string, has_kinect int, packaging_state string, "
        "is_base_model int, is_base_model_auto int, url string, image_url string, first_seen timestamp, last_seen timestamp, "
        "last_price double, last_available int"
    ),
    "state_changes": (
        "id long, product_id long, changed_at timestamp, price_old double, price_new double, available_old int, available_new int, change_type string"
    ),
    "categories": "id long, name string, parent_id long",
    "storage_sizes": "id long, label string",
    "ads": (
        f"id long, urn_id string, name string, body_text string, text_hash string, classify_version string, {_RULES}, url string, image_url string, "
        "city string, region string, seller_type string, published_at string, first_seen timestamp, last_seen timestamp, last_active_seen timestamp, "
        "first_inactive_seen timestamp, last_price double, last_available int, ai_status string, ai_confidence double, ai_taxonomy_id string, "
        "ai_object_type string, ai_price_signal string, ai_prompt_version string, ai_input_hash string, ai_reviewed_at timestamp, "
        "sold_at timestamp, sold_at_estimated timestamp, sold_window_hours double, verify_status string, last_verified_at timestamp"
    ),
    "ad_changes": (
        "id long, ad_id long, changed_at timestamp, price_old double, price_new double, available_old int, available_new int, change_type string"
    ),
    "sold_items": (
        f"id long, item_id string, name string, {_RULES}, sold_price double, sold_date string, url string, query_label string, "
        "first_seen timestamp, last_seen timestamp"
    ),
    "sold_changes": "id long, item_id long, changed_at timestamp, price_old double, price_new double",
    "classification_runs": (
        "id long, ad_id long, input_hash string, taxonomy_version string, prompt_version string, status_final string, taxonomy_id_final string, "
        "confidence_final long, selected_model string, created_at timestamp"
    ),
    "classification_attempts": (
        "id long, step_number int, model string, taxonomy_id string, confidence long, object_type string, price_signal string, decision_reason string"
    ),
    "human_reviews": (
        "ad_id long, run_id long, ai_taxonomy_id string, human_taxonomy_id string, human_status string, review_reason string, reviewed_at timestamp"
    ),
    "job_runs": (
        "id long, job string, host string, source string, status string, started_at timestamp, ended_at timestamp, duration_s double, counts string, error string"
    ),
    "alert_log": "urn_id string, ts string",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order and type; columns that are absent come out null."""
    return empty(df.sparkSession, name).unionByName(df.select(*[c for c in df.columns if c in _columns(name)]), allowMissingColumns=True)


def _columns(name: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in TABLES[name].split(",")]
