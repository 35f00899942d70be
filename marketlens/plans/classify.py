"""Title classification against the catalogue, and standard names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketlens.catalog import CONSOLE_RULES, TitleRules
from marketlens.functions import money, titles
from marketlens.functions.scores import lookup
from marketlens.functions.text import matches, plain_words, slug, squeeze, title_case
from marketlens.operators.joins import taxonomy_table
from marketlens.operators.similarity import best_anchor

CLASS_COLUMNS = (
    "console_family", "sub_model", "model_segment", "edition_class", "canonical_model", "classify_confidence", "classify_method",
)


def catalogue_lists(taxonomy: DataFrame, rules: TitleRules = CONSOLE_RULES) -> DataFrame:
    """One row per family and model with its catalogue rows in order (a fixed table of few rows)."""
    row = F.struct(
        "rank", "id", F.col("type").alias("type"), money.memory_gb(F.col("memory"), rules.unit_tb).alias("gb"),
        plain_words(F.col("shell")).alias("shell"), F.split(plain_words(F.col("shell")), " ").alias("words"), F.col("label").alias("label"),
        F.col("model").alias("model"),
    )
    return taxonomy.groupBy(F.col("family_key").alias("_fam"), F.col("model").alias("_mod")).agg(
        F.sort_array(F.collect_list(row)).alias("_rows")
    )


def best_row(pool: Column, words: Column, digital: Column) -> Column:
    """The catalogue row a title means: special shell, digital, shell, canonical.

    ``pool`` are its rows of the title's memory, ``words`` the title in plain words. All three are
    looked at once per catalogue row, so they should be columns, not expressions over the title.
    """
    def first(test) -> Column:
        return F.get(F.filter(pool, test), 0)

    special = first(lambda r: (r["type"] == "Speciale") & titles.shell_in_title(r["shell"], r["words"], words))
    of_digital = F.when(digital, first(lambda r: F.contains(r["shell"], F.lit("digital"))))
    shelled = first(lambda r: (r["type"] == "Canonico") & titles.shell_in_title(r["shell"], r["words"], words))
    canonical = first(lambda r: r["type"] == "Canonico")
    return F.coalesce(special, of_digital, shelled, canonical, F.get(pool, 0))


def _with_best_row(joined: DataFrame, rules: TitleRules) -> DataFrame:
    """Adds ``_row`` for titles ``_t`` with catalogue rows ``_rows``; each title is read once per pattern, not per catalogue row."""
    listed = F.col("_rows").isNotNull()
    read = joined.withColumns({
        "_memory": F.when(listed, money.title_memory(F.col("_t"), rules.patterns, rules.unit_tb)),
        "_words": F.when(listed, plain_words(F.col("_t"))),
        "_digital": F.when(listed, matches(F.col("_t"), rules.patterns["digital"])),
    })
    # Rows of the title's memory, or all where there is none; a cut in the plan, or the columns above are put back into each use.
    same = F.filter("_rows", lambda r: r["gb"] == F.col("_memory"))
    pooled = read.withColumn("_same", same).withColumn("_pool", F.when(F.size("_same") > 0, F.col("_same")).otherwise(F.col("_rows")))
    return pooled.withColumn("_row", F.when(listed, best_row(F.col("_pool"), F.col("_words"), F.col("_digital"))))


def classify_titles(
    df: DataFrame, name: str = "name", hint: str | None = None, rules: TitleRules = CONSOLE_RULES, taxonomy: DataFrame | None = None
) -> DataFrame:
    """Adds the classification columns and ``label``; no shuffle, the catalogue is a fixed broadcast table."""
    taxonomy = taxonomy if taxonomy is not None else taxonomy_table(df.sparkSession, rules)
    title = F.trim(F.coalesce(F.col(name), F.lit("")))
    hint_col = F.col(hint) if hint else F.lit(None).cast("string")
    hinted = titles.canonical_family(hint_col, rules)
    keep = [c for c in df.columns if c not in (*CLASS_COLUMNS, "label")]
    base = df.select(*[F.col(c) for c in keep], title.alias("_t"), hint_col.alias("_hint"), hinted.alias("_hf"))
    base = base.withColumn("_fam", F.when(F.col("_hf") != "other", F.col("_hf")).otherwise(titles.detect_family(F.col("_t"), rules)))
    base = base.withColumn("_mod", titles.model_of(F.col("_t"), F.col("_fam"), F.col("_hint"), rules))
    joined = base.join(catalogue_lists(taxonomy, rules), ["_fam", "_mod"], "left")
    joined = _with_best_row(joined, rules)
    found = F.col("_row").isNotNull()
    edition = F.when(found, F.when(F.col("_row.type") == "Speciale", "special").otherwise("standard")).otherwise(
        titles.edition_class(F.col("_t"), rules)
    )
    joined = joined.withColumn("_ed", edition)
    unknown = (F.col("_fam") == "other") | ~found
    premium = (F.col("_ed") != "standard") | matches(F.col("_t"), rules.patterns["premium"])
    return joined.select(
        *keep,
        F.col("_fam").alias("console_family"),
        titles.sub_model(F.coalesce("_row.model", "_mod"), rules).alias("sub_model"),
        F.when(unknown, "unknown").when(premium, "premium").otherwise("base").alias("model_segment"),
        F.col("_ed").alias("edition_class"),
        F.coalesce("_row.id", F.lit("unknown")).alias("canonical_model"),
        F.when(unknown, 0.35).when(premium, 0.88).otherwise(0.9).alias("classify_confidence"),
        F.lit(rules.method).alias("classify_method"),
        F.col("_row.label").alias("label"),
    )


def _fallback_name(title: Column, family: Column, rules: TitleRules) -> Column:
    bare = F.regexp_replace(title, r"\[[^\]]*\]", " ")
    bare = F.regexp_replace(bare, "(?iU)" + rules.patterns["noise"], " ")
    bare = squeeze(F.regexp_replace(bare, r"[(){}]", " "))
    bare = F.regexp_replace(bare, "^[ _,-]+|[ _,-]+$", "")
    family_title = lookup(rules.family_titles, family) if rules.family_titles else F.lit(None).cast("string")
    return F.when(bare != "", title_case(bare)).otherwise(F.coalesce(family_title, F.lit(rules.default_title)))


def standardize_titles(df: DataFrame, name: str = "name", rules: TitleRules = CONSOLE_RULES) -> DataFrame:
    """Adds ``standard_name`` and ``standard_key``; expects the columns of ``classify_titles``."""
    title = F.trim(F.coalesce(F.col(name), F.lit("")))
    p = rules.patterns
    known = F.col("label").isNotNull()
    digital = matches(title, p["digital"])
    edition = (
        F.when(matches(title, p["limited"]), "limited").when(matches(title, p["special"]), "special")
        .when(F.col("edition_class").isin("limited", "special"), F.col("edition_class")).otherwise("standard")
    )
    base = F.coalesce("label", _fallback_name(title, F.col("console_family"), rules))
    base = F.when(digital & ~F.contains(F.lower(base), F.lit("digital")), F.concat(base, F.lit(" Digital"))).otherwise(base)
    named = titles.edition_in_title(title, rules)
    shades = titles.colors(title, rules)
    out = df.withColumn("_base", base).withColumn("_named", named).withColumn("_edition", edition).withColumn("_shades", shades)
    suffix = (
        F.when(F.col("_named").isNotNull(), F.concat(F.lit(" ["), "_named", F.lit("]")))
        .when(F.col("_edition") == "limited", " [LIMITED]").when(F.col("_edition") == "special", " [SPECIAL]").otherwise("")
    )
    shaded = F.when(F.col("_shades") != "", F.concat(F.lit(" - "), "_shades")).otherwise("")
    name_out = F.when(known, F.col("_base")).otherwise(F.concat("_base", suffix, shaded))
    canonical = F.coalesce("canonical_model", F.lit(""))
    key = F.concat_ws(
        "|",
        F.when((canonical != "") & (canonical != "unknown"), canonical).otherwise(slug(F.col("_base"))),
        F.when(digital, "digital").otherwise("standard"),
        F.when(known, F.col("edition_class")).otherwise(F.coalesce(slug(F.col("_named")), F.col("_edition"))),
    )
    return out.withColumn("standard_name", name_out).withColumn("standard_key", key).drop("_base", "_named", "_edition", "_shades")


def search_attributes(df: DataFrame, name: str = "name", rules: TitleRules = CONSOLE_RULES) -> DataFrame:
    title = F.coalesce(F.col(name), F.lit(""))
    return (
        df.withColumn("edition_name", titles.edition_name(title, rules))
        .withColumn("color", titles.colors(title, rules))
        .withColumn("has_kinect", titles.kinect(title, rules))
    )


def rules_and_anchor_pass(
    ads: DataFrame, anchors: DataFrame, rules: TitleRules = CONSOLE_RULES, taxonomy: DataFrame | None = None, version: str = "rules+ai:title+body:v2",
) -> tuple[DataFrame, DataFrame]:
    """Rules on title and body; plain base models then take the model of the closest anchor.

    Second result: rows the rules could not settle.
    """
    text = F.trim(F.concat(F.col("name"), F.lit("\n"), squeeze(F.col("body_text"))))
    hinted = ads.withColumn("_text", text).withColumn("_family_hint", F.col("console_family"))
    ruled = classify_titles(hinted, "_text", "_family_hint", rules, taxonomy).drop("_text", "_family_hint", "label")
    plain_base = (F.col("console_family") != "other") & (F.col("model_segment") == "base") & (F.col("edition_class") == "standard")
    matched = best_anchor(ruled.where(plain_base), anchors)
    rest = ruled.where(~plain_base).withColumn("match_model", F.lit(None).cast("string")).withColumn("match_score", F.lit(None).cast("double"))
    both = matched.unionByName(rest)
    hit = F.col("match_model").isNotNull()
    lifted = F.greatest(F.col("classify_confidence"), F.lit(0.65) + F.col("match_score") * 0.3)
    out = (
        both.withColumn("canonical_model", F.coalesce("match_model", "canonical_model"))
        .withColumn("classify_confidence", F.least(F.lit(1.0), F.when(hit, lifted).otherwise(F.col("classify_confidence"))))
        .withColumn("classify_method", F.when(hit, F.lit("cex-match:v1")).otherwise(F.col("classify_method")))
        .withColumn("classify_version", F.lit(version))
    )
    open_rows = (F.col("console_family") == "other") | (F.col("model_segment") == "unknown") | (F.col("classify_confidence") < 0.6)
    return out, out.where(open_rows)
