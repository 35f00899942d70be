"""Best anchor per title by token overlap, and nearest price within a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketlens.functions.text import jaccard, tokens
from marketlens.operators.ordering import nearest_known, null_safe_join

#: Word sets that may meet at one word in one task, on either side.
CELL = 20_000


def load_anchors(products: DataFrame, source: str = "cex") -> DataFrame:
    return products.where(
        (F.col("source") == source) & (F.col("model_segment") == "base") & (F.col("edition_class") == "standard")
        & F.col("canonical_model").isNotNull() & (F.trim("canonical_model") != "")
    ).select("id", "name", F.coalesce("console_family", F.lit("other")).alias("console_family"), "canonical_model")


def best_anchor(
    titles: DataFrame, anchors: DataFrame, *, name: str = "name", family: str = "console_family", threshold: float = 0.45,
    stop: Sequence[str] | None = None,
) -> DataFrame:
    """Adds ``match_model`` and ``match_score`` of the most similar anchor of the same family.

    Equal titles are matched once. Two word sets can only reach the threshold when the rare
    ends of both share a word early enough, so only those pairs are compared; the result is that
    of comparing everything. A word in many sets is split into cells of about ``CELL`` sets a
    side (:func:`_in_cells`). The first anchor (lowest id) wins a tie; titles without words, and
    those of a family without anchors, get nulls.
    """
    words = (lambda c: F.sort_array(tokens(c))) if stop is None else (lambda c: F.sort_array(tokens(c, stop)))
    keyed = titles.withColumn("_set", words(F.col(name)))
    wanted = keyed.select(F.col(family).alias("_fam"), "_set").where(F.size("_set") > 0).distinct()
    offered = (
        anchors.select(F.col(family).alias("_fam"), words(F.col(name)).alias("_aset"), "id", "canonical_model")
        .where(F.size("_aset") > 0)
        .groupBy("_fam", "_aset")
        .agg(F.min("id").alias("_aid"), F.min_by("canonical_model", "id").alias("_model"))
    )
    rarity = offered.select("_fam", F.explode("_aset").alias("_w")).groupBy("_fam", "_w").agg(F.count("*").alias("_df"))
    # Scores are rounded to three places before the threshold, hence the half step.
    floor = threshold - 0.0006

    def rare_end(sets: DataFrame, col: str) -> DataFrame:
        spread = sets.select("_fam", col, F.explode(col).alias("_w"))
        known = spread.join(rarity, ["_fam", "_w"], "left")
        ordered = known.groupBy("_fam", col).agg(
            F.sort_array(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("_w").alias("w")))).alias("_o")
        )
        length = F.size("_o") - F.ceil(F.size("_o") * floor) + 1
        return ordered.select("_fam", col, F.posexplode(F.transform(F.slice("_o", 1, length.cast("int")), lambda s: s["w"])).alias(f"{col}_at", "_w"))

    asked, known = _in_cells(rare_end(wanted, "_set"), "_set", rare_end(offered.select("_fam", "_aset"), "_aset"), "_aset")
    # At the first word two sets share, no more words can follow than the shorter rest holds.
    reach = F.least(F.size("_set") - F.col("_set_at"), F.size("_aset") - F.col("_aset_at"))
    needed = (F.size("_set") + F.size("_aset")) * (floor / (1 + floor)) - 1e-9
    pairs = (
        asked.join(known, ["_fam", "_w", "_i", "_j"])
        .where((F.size("_aset") >= F.size("_set") * floor) & (F.size("_set") >= F.size("_aset") * floor) & (reach >= needed))
        .select("_fam", "_set", "_aset")
        .distinct()
    )
    scored = pairs.join(offered, ["_fam", "_aset"]).withColumn("_score", jaccard(F.col("_set"), F.col("_aset")))
    best = (
        scored.groupBy("_fam", "_set")
        .agg(F.max_by(F.struct("_model", "_score"), F.struct(F.col("_score"), -F.col("_aid"))).alias("_best"))
        .select(F.col("_fam"), "_set", F.col("_best._model").alias("match_model"), F.bround("_best._score", 3).alias("match_score"))
        .where(F.col("match_score") >= threshold)
    )
    best = best.withColumnRenamed("_fam", family)
    return null_safe_join(keyed, best, [family, "_set"], "left").drop("_set")


def _in_cells(left: DataFrame, lset: str, right: DataFrame, rset: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with cell numbers ``_i``, ``_j``, for a join on ``_fam``, ``_w`` and the two.

    Sets at a word are dealt to cells of about ``CELL`` by their hash; each goes to all cells of the
    other side, so every pair still meets once. Words with fewer sets are one cell.
    """
    at = ["_fam", "_w"]
    held = left.groupBy(*at).agg(F.count("*").alias("_l")).join(right.groupBy(*at).agg(F.count("*").alias("_r")), at)
    hot = held.where((F.col("_l") > CELL) | (F.col("_r") > CELL)).select(
        *at, F.ceil(F.col("_l") / CELL).alias("_nl"), F.ceil(F.col("_r") / CELL).alias("_nr")
    )

    def dealt(rows: DataFrame, col: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        known = null_safe_join(rows, hot, at, "left")
        mine = F.pmod(F.xxhash64(col), F.coalesce(own_n, F.lit(1)))
        theirs = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other_n, F.lit(1)) - 1))
        return known.withColumn(own, mine).withColumn(other, theirs).drop("_nl", "_nr")

    return dealt(left, lset, "_i", "_nl", "_j", "_nr"), dealt(right, rset, "_j", "_nr", "_i", "_nl")


def nearest_price(legacy: DataFrame, variants: DataFrame, group: str, price: str) -> DataFrame:
    """``keep_id``: the variant of the same group whose price is closest, lowest id on a tie.

    Without comparable prices it is the group's first variant; groups without variants drop out.
    Asked and offered prices become one sorted line of distinct prices per group, along which
    each price meets its neighbours on both sides: no pairs of a group, and rows that ask for
    one price are answered once.
    """
    first = variants.groupBy(group).agg(F.min("id").alias("_first"))
    of = lambda rows, vid, asked: rows.where(F.col(price).isNotNull()).select(
        F.col(group).alias("_grp"), F.col(price).cast("double").alias("_p"), vid.alias("_vid"), F.lit(asked).alias("_asked")
    )
    line = of(variants, F.col("id"), False).unionByName(of(legacy, F.lit(None).cast(variants.schema["id"].dataType), True))
    line = line.groupBy("_grp", "_p").agg(F.min("_vid").alias("_vid"), F.max("_asked").alias("_asked"))
    point = F.when(F.col("_vid").isNotNull(), F.struct(F.col("_p").alias("p"), F.col("_vid").alias("v")))
    both = nearest_known(line.withColumn("_point", point), ["_grp"], ["_p"], "_point", "_low", "_high")

    def distance(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["p"] - F.col("_p")).alias("d"), F.col(c)["v"].alias("v")))

    chosen = both.where("_asked").select("_grp", "_p", F.least(distance("_low"), distance("_high"))["v"].alias("_near"))
    asked = legacy.join(first, group).select("id", F.col(group).alias("_g"), F.col(price).cast("double").alias("_q"), "_first")
    found = asked.join(chosen, (F.col("_g") == F.col("_grp")) & (F.col("_q") == F.col("_p")), "left")
    return found.select(F.col("id").alias("legacy_id"), F.coalesce("_near", "_first").alias("keep_id"))
