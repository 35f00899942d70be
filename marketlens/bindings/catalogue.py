"""Products, dimensions, change logs, merging, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens import catalog
from marketlens.bindings.roles import FACT_ID, FACT_SQL, LOG_SQL, PRODUCTS_SQL, change_log, fact, products, show_ts, stamp, table
from marketlens.functions.scores import lookup
from marketlens.operators import aggregates, filters, joins, similarity, windows
from marketlens.operators.ordering import previous_row
from marketlens.plans import ingest, showcase, statistics
from marketlens.sources import snapshots, tables

_TS = "%Y-%m-%d %H:%M:%S"


# --- dimensions -------------------------------------------------------------------------------

def _dims(spark, sf):
    """Types as categories under their rank, sizes as storage sizes under their own number."""
    parts = table(spark, sf, "part")
    ranks = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}
    cats = parts.select(F.col("p_type").alias("name")).distinct().withColumn("id", lookup(ranks, F.col("name")).cast("long"))
    sizes = parts.select(F.col("p_size").cast("long").alias("id")).distinct().withColumn("label", F.concat(F.col("id").cast("string"), F.lit(" GB")))
    rows = parts.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), lookup(ranks, F.col("p_type")).cast("long").alias("category_id"),
        F.col("p_size").cast("long").alias("storage_id"), F.when(F.col("p_retailprice") < 950, 1).otherwise(0).alias("is_base_model"),
    )
    return rows, cats, sizes


def catalog_view(spark, sf):
    return joins.catalog_view(*_dims(spark, sf)).select("id", "name", "category", "storage_label")


def base_models(spark, sf):
    return joins.base_models(*_dims(spark, sf)).select("id", "name", "category", "storage_label")


def dimensions(spark, sf):
    _, cats, sizes = _dims(spark, sf)
    return tables.dimension(cats, "name").withColumnRenamed("name", "value").unionByName(tables.dimension(sizes, "label").withColumnRenamed("label", "value"))


def get_or_create_dim(spark, sf):
    """Known labels are the nations of the first region; customers bring the others in key order."""
    nations = table(spark, sf, "nation")
    known = nations.where(F.col("n_regionkey") == 0).select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("label"))
    seen = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("label"), "c_custkey")
    return joins.get_or_create_dim(known, seen, "label", "c_custkey")


# --- groups, combos, search ----------------------------------------------------------------------

def _named(spark, sf):
    rows = products(spark, sf)
    return rows.select(
        "id", "source", "name", "condition", F.when(F.col("size") > 10, F.upper("name")).alias("standard_name"),
        F.when(F.col("size") > 30, F.concat("name", F.lit("|"), F.col("condition"))).alias("standard_key"),
        F.when(F.col("size") > 20, "Scontata").alias("packaging_state"), "last_price", "last_available", "size",
    )


def standard_groups(spark, sf):
    out = aggregates.standard_groups(_named(spark, sf))
    return out.select("standard_key", "standard_name", "total_products", *[F.array_join(c, ",").alias(c) for c in ("sources", "packaging_states", "conditions")])


def standard_group_items(spark, sf):
    return aggregates.standard_group_items(_named(spark, sf))


def filter_standard_groups(spark, sf):
    rows = _named(spark, sf)
    out = aggregates.filter_standard_groups(aggregates.standard_groups(rows), aggregates.standard_group_items(rows), "Red W")
    return out.select("standard_key", "standard_name", "total_products")


_NAMED = PRODUCTS_SQL + """,
named AS (
  SELECT id, source, name, condition, last_price, CASE WHEN size > 20 THEN 'Scontata' ELSE 'Imballata' END AS packaging,
         CASE WHEN size > 10 THEN upper(name) ELSE name END AS standard_name,
         CASE WHEN size > 30 THEN name || '|' || condition ELSE 'name:' || lower(CASE WHEN size > 10 THEN upper(name) ELSE name END) END AS standard_key
  FROM products),
groups AS (
  SELECT standard_key, first(standard_name ORDER BY source, name, condition, id) AS standard_name, count(*) AS total_products,
         array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, array_to_string(list_sort(list(DISTINCT packaging)), ',') AS packaging_states,
         array_to_string(list_sort(list(DISTINCT condition)), ',') AS conditions
  FROM named GROUP BY 1)"""


def search_groups(spark, sf):
    return aggregates.search_groups(_named(spark, sf))


def search(spark, sf):
    rows = products(spark, sf).select(
        "id", "last_price", "last_available", F.lower("condition").alias("console_family"), F.col("source").alias("sub_model"), F.upper("name").alias("standard_name"),
        F.replace("name", F.lit(" "), F.lit("/")).alias("color"), F.concat(F.col("size").cast("string"), F.lit(" GB")).alias("storage_label"),
        F.when(F.contains("name", F.lit("ring")), 1).otherwise(0).alias("has_kinect"), F.lit("Standard").alias("edition_name"),
    )
    out = filters.search(rows, base_family="Both", edition="Standard", color="RED", has_kinect=1, available_only=True, groups={"Both": ("promo", "small", "economy")})
    return out.select("id", "standard_name", "last_price")


def facet_filter(spark, sf):
    rows = products(spark, sf).select(
        "id", "name", F.upper("name").alias("standard_name"), "source", F.col("condition").alias("console_family"), F.col("condition"), F.lit("512 GB").alias("storage_label"),
        F.element_at(F.split("name", " "), 1).alias("sub_model"), F.lower("condition").alias("edition_class"), F.lit("x").alias("parsed_edition"), F.lit("y").alias("edition_name"),
        "last_available", F.when(F.col("size") > 5, 1).otherwise(0).alias("is_base_model"), "last_price",
    )
    out = filters.facet_filter(
        rows, text=" R", families=("prom", "econ"), conditions=("PROMO", "ECONOMY", "LARGE"), storage="512 GB", segments=("red", "blue", "small"), edition="promo", available_only=True, base_only=True,
    )
    return windows.sort_view(out, "last_price").select("id", "name", "last_price")


def edition_facets(spark, sf):
    rows = table(spark, sf, "part").select(F.when(F.col("p_type") == "STANDARD", "standard").otherwise(F.col("p_name")).alias("edition"))
    return aggregates.edition_facets(rows, "edition")


def _combos(spark, sf):
    """Parts as favourites, order lines as catalogue: one combo per name and brand."""
    parts = table(spark, sf, "part")
    combo = F.concat_ws("|", "p_brand", F.element_at(F.split("p_name", " "), 2))
    base = parts.where(F.col("p_size") > 45).select(
        F.col("p_partkey").alias("id"), combo.alias("combo_key"), F.col("p_brand").alias("parsed_family"), F.element_at(F.split("p_name", " "), 2).alias("parsed_segment"),
        F.col("p_type").alias("storage_label"), F.lit("cex").alias("source"), F.col("p_retailprice").alias("price"), F.lit(1).alias("available"),
        F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("url"),
    )
    lines = fact(spark, sf)
    stores = {"cex": "cex", "ebay": "rebuy", "subito": "gamelife"}
    offers = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_o"), F.concat_ws("|", "console_family", F.element_at(F.split("name", " "), 2)).alias("combo_key"),
        F.col("console_family").alias("parsed_family"), F.element_at(F.split("name", " "), 2).alias("parsed_segment"), F.coalesce("canonical_model", F.lit("SMALL")).alias("storage_label"),
        lookup(stores, F.col("source")).alias("source"), "price", "available",
        # Every part is offered once per store: the same address again is the same offer.
        F.concat(F.lit("o/"), F.col("l_partkey").cast("string"), F.lit("/"), F.col("source")).alias("url"), *FACT_ID,
    )
    keyed = joins.first_per_key(offers, ["url"], FACT_ID)
    numbered = joins.next_ids(keyed, base, [F.col("url")]).drop("_o", *FACT_ID)
    pooled = showcase.unique_urls(windows.pool([base, numbered]))
    return showcase.combo_items(pooled, base), pooled, base


def combo_groups(spark, sf):
    items, _, _ = _combos(spark, sf)
    return showcase.combo_groups(items).drop("storage_label")


def combo_groups_other(spark, sf):
    _, pooled, base = _combos(spark, sf)
    return showcase.combo_groups(showcase.combo_items(pooled, base, invert=True)).select("combo_key", "count", "min_price", "max_price")


def model_grid(spark, sf):
    items, _, _ = _combos(spark, sf)
    return showcase.order_grid(showcase.model_grid(items))


_COMBOS = FACT_SQL + f""",
base AS (
  SELECT p_partkey AS id, p_brand || '|' || string_split(p_name, ' ')[2] AS combo_key, p_brand AS parsed_family, string_split(p_name, ' ')[2] AS parsed_segment, 'cex' AS source,
         p_retailprice AS price, 1 AS available FROM part WHERE p_size > 45),
first_offers AS (
  SELECT *, 'o/' || l_partkey || '/' || source AS url, row_number() OVER (PARTITION BY l_partkey, source ORDER BY {", ".join(FACT_ID)}) AS rn FROM fact),
stored AS (
  SELECT (SELECT max(id) FROM base) + row_number() OVER (ORDER BY url) AS id, console_family || '|' || string_split(name, ' ')[2] AS combo_key, console_family AS parsed_family,
         string_split(name, ' ')[2] AS parsed_segment, CASE source WHEN 'cex' THEN 'cex' WHEN 'ebay' THEN 'rebuy' ELSE 'gamelife' END AS source, price, available
  FROM first_offers WHERE rn = 1),
pool AS (SELECT * FROM base UNION ALL SELECT * FROM stored),
best AS (SELECT *, row_number() OVER (PARTITION BY combo_key, source ORDER BY price DESC, id) AS rk FROM pool),
items AS (SELECT * FROM best WHERE combo_key IN (SELECT combo_key FROM base) AND (source <> 'rebuy' OR rk = 1)),
others AS (SELECT * FROM best WHERE combo_key NOT IN (SELECT combo_key FROM base) AND (source <> 'rebuy' OR rk = 1))"""


def overrides(spark, sf):
    """Order priorities fix the storage of some products."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("display_id"), F.concat(F.col("p_size").cast("string"), F.lit(" GB")).alias("storage_label"))
    fixes = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 3).alias("display_id"), F.when(F.col("s_acctbal") > 0, "1 TB").alias("fixed_storage"), F.when(F.col("s_acctbal") > 5000, "Nero").alias("fixed_color"),
        F.lit(None).cast("string").alias("fixed_edition"),
    )
    return joins.apply_overrides(rows, fixes).drop("fixed_edition")


def parsed_view(spark, sf):
    """Parsed columns of part names, with the built-in manual fixes by id."""
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("display_id"), F.concat(F.lit("Xbox One "), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("GB")).alias("name"),
        F.lit(None).cast("string").alias("edition_class"), F.lit("Usato").alias("condition"),
    )
    out = showcase.parsed_view(rows, joins.overrides_table(spark))
    return out.select("display_id", "parsed_family", "parsed_segment", "parsed_color", "parsed_edition", "storage_label", "combo_key")


def _parsed_sql() -> str:
    values = ", ".join(
        "(" + ", ".join("NULL" if v is None else (str(v) if isinstance(v, int) else "'" + v + "'") for v in row) + ")" for row in catalog.OVERRIDES
    )
    return f"""WITH o(oid, st, co, ed) AS (VALUES {values}),
a AS (
  SELECT p_partkey AS display_id, p_size, CASE WHEN p_name LIKE '%red%' THEN 'Rosso' END AS c1, CASE WHEN p_name LIKE '%blue%' THEN 'Blu' END AS c2, st, co, ed
  FROM part LEFT JOIN o ON oid = p_partkey),
b AS (SELECT *, concat_ws(', ', c1, c2, CASE WHEN co IS DISTINCT FROM c1 AND co IS DISTINCT FROM c2 THEN co END) AS shades, coalesce(st, p_size || ' GB') AS storage FROM a),
c AS (SELECT *, coalesce(ed, CASE WHEN shades <> '' THEN shades END, 'Standard') AS edition FROM b)
SELECT display_id, 'One' AS parsed_family, 'Base' AS parsed_segment, shades AS parsed_color, edition AS parsed_edition, storage AS storage_label,
       'One|Base|' || edition || '|false|' || storage || '|Usato|Imballata' AS combo_key
FROM c"""


# --- numbering and merging -----------------------------------------------------------------------

_PREFIXES = {f"brand#{i}": i for i in range(1, 20)}


def display_ids(spark, sf):
    rows = products(spark, sf).select("id", "source", "name", "condition")
    return windows.display_ids(rows, _PREFIXES, 99, {"SMALL": 0, "LARGE": 1}, base=100000).select("id", "display_id", "rank_fits")


def dedupe_first(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).otherwise("").alias("sku"),
        F.when(F.col("o_orderstatus") == "F", F.concat("o_orderpriority", F.col("o_custkey").cast("string"))).alias("url"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("name"),
    )
    return windows.dedupe_first(rows, ["pos"]).select("pos")


def _mergeable(spark, sf):
    return products(spark, sf).select(
        "id", "name", "source", "condition", "url", "first_seen", "last_seen", "last_price", "last_available",
        F.when(F.col("size") > 25, F.col("name")).alias("sku"), F.when(F.col("size") > 40, 1).otherwise(0).alias("is_base_model"),
    )


_BY_URL = ("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5")


def dedupe_merge(spark, sf):
    out, _ = windows.dedupe_by_url(_mergeable(spark, sf), _BY_URL)
    return out.select("id", "source", "sku", "last_price", "last_available", "is_base_model", show_ts("first_seen").alias("first_seen"), show_ts("last_seen").alias("last_seen"))


def dedupe_moves(spark, sf):
    _, moved = windows.dedupe_by_url(_mergeable(spark, sf), _BY_URL)
    return moved


_MERGED = PRODUCTS_SQL + """,
keyed AS (
  SELECT *, CASE WHEN size > 25 THEN name END AS sku, CASE WHEN size > 40 THEN 1 ELSE 0 END AS is_base_model,
         CASE WHEN source IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') THEN source || url ELSE 'one' || id END AS grp
  FROM products),
folded AS (
  SELECT grp, first(id ORDER BY length(name) DESC, last_seen DESC NULLS LAST, id DESC) AS id, any_value(source) AS source,
         last(sku ORDER BY last_seen NULLS FIRST, id) FILTER (sku IS NOT NULL) AS sku, last(last_price ORDER BY last_seen NULLS FIRST, id) FILTER (last_price IS NOT NULL) AS last_price,
         last(last_available ORDER BY last_seen NULLS FIRST, id) FILTER (last_available IS NOT NULL) AS last_available, max(is_base_model) AS is_base_model,
         min(first_seen) AS first_seen, max(last_seen) AS last_seen
  FROM keyed GROUP BY grp)"""


def normalize_conditions(spark, sf):
    """Two brands take one condition; what then coincides is merged."""
    out, _ = ingest.normalize_conditions(_mergeable(spark, sf), {"Brand#1": "SMALL", "Brand#2": "PROMO"})
    return out.select("id", "source", "name", "condition", "is_base_model", show_ts("first_seen").alias("first_seen"))


_CONDITIONS = PRODUCTS_SQL + """,
wanted AS (
  SELECT *, CASE WHEN size > 40 THEN 1 ELSE 0 END AS is_base_model, CASE source WHEN 'Brand#1' THEN 'SMALL' WHEN 'Brand#2' THEN 'PROMO' ELSE condition END AS want FROM products)"""


def nearest_price(spark, sf):
    """Lines of one type join the closest priced line of another type of the same brand."""
    rows = fact(spark, sf).select(
        F.struct(*FACT_ID).alias("_k"), F.coalesce("canonical_model", F.lit("SMALL")).alias("kind"), "console_family", F.when(F.col("size") > 3, F.col("price")).alias("price"), *FACT_ID
    )
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")
    rows = rows.withColumn("id", key * 1000 + F.col("l_suppkey") % 1000)
    legacy = rows.where(F.col("kind") == "SMALL").select("id", "console_family", "price")
    variants = rows.where(F.col("kind") == "PROMO").select("id", "console_family", "price")
    out = similarity.nearest_price(legacy, variants, "console_family", "price")
    return out.groupBy("legacy_id").agg(F.min("keep_id").alias("keep_id"))


_NEAREST = FACT_SQL + """,
rows AS (
  SELECT ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 AS id, console_family, coalesce(canonical_model, 'SMALL') AS kind, CASE WHEN size > 3 THEN price END AS price
  FROM fact),
lo AS (SELECT l.id, v.price AS p FROM (SELECT * FROM rows WHERE kind = 'SMALL' AND price IS NOT NULL) l ASOF JOIN (SELECT * FROM rows WHERE kind = 'PROMO' AND price IS NOT NULL) v ON l.console_family = v.console_family AND l.price >= v.price),
hi AS (SELECT l.id, v.price AS p FROM (SELECT * FROM rows WHERE kind = 'SMALL' AND price IS NOT NULL) l ASOF JOIN (SELECT * FROM rows WHERE kind = 'PROMO' AND price IS NOT NULL) v ON l.console_family = v.console_family AND l.price <= v.price),
ids AS (SELECT console_family, price, min(id) AS vid FROM rows WHERE kind = 'PROMO' AND price IS NOT NULL GROUP BY 1, 2),
firsts AS (SELECT console_family, min(id) AS vid FROM rows WHERE kind = 'PROMO' GROUP BY 1),
cand AS (
  SELECT r.id, r.price, f.vid AS first_id, a.vid AS low_id, abs(r.price - lo.p) AS dl, b.vid AS high_id, abs(r.price - hi.p) AS dh
  FROM rows r JOIN firsts f USING (console_family) LEFT JOIN lo ON lo.id = r.id LEFT JOIN hi ON hi.id = r.id
  LEFT JOIN ids a ON a.console_family = r.console_family AND a.price = lo.p LEFT JOIN ids b ON b.console_family = r.console_family AND b.price = hi.p
  WHERE kind = 'SMALL'),
picked AS (
  SELECT id AS legacy_id, CASE WHEN low_id IS NULL AND high_id IS NULL THEN first_id WHEN high_id IS NULL OR dl < dh OR (dl = dh AND low_id < high_id) THEN coalesce(low_id, high_id) ELSE high_id END AS keep_id FROM cand)
SELECT legacy_id, min(keep_id) AS keep_id FROM picked GROUP BY 1"""


def _merge_sides(spark, sf):
    """Orders up to 1999 are on the server; the other side brings all orders of 1999 and later, keyed by customer and priority."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("seller"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("price"), "o_orderdate", "o_orderstatus"
    )
    here = orders.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")).drop("o_orderstatus")
    there = orders.where(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ad_id"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return here, there, lines


def _merged(spark, sf):
    here, there, lines = _merge_sides(spark, sf)
    return joins.additive_merge(here, there, ["seller", "kind"], lines, lines, "ad_id")


def additive_merge_parent(spark, sf):
    new, _ = _merged(spark, sf)
    return new.select("id", "seller", "kind", "price")


def additive_merge_child(spark, sf):
    _, kids = _merged(spark, sf)
    return kids.groupBy("ad_id").agg(F.count("*").alias("rows"), F.sum("quantity").alias("quantity"))


_ADDITIVE = """
here AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'),
fresh AS (SELECT * FROM firsts f WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM here h WHERE h.o_custkey = f.o_custkey AND h.o_orderpriority = f.o_orderpriority)),
numbered AS (SELECT (SELECT max(o_orderkey) FROM here) + row_number() OVER (ORDER BY o_orderkey) AS id, * FROM fresh)"""


def insert_or_ignore(spark, sf):
    here, there, _ = _merge_sides(spark, sf)
    return tables.copy_table(here.drop("o_orderdate"), there.drop("o_orderdate"), ["seller", "kind"]).select("id", "seller", "kind")


def jaccard_match(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"), F.col("p_brand").alias("console_family"), F.col("p_size"))
    anchors = parts.where(F.col("p_size") > 35).withColumn("canonical_model", F.concat(F.lit("m"), F.col("id").cast("string")))
    out = similarity.best_anchor(parts.drop("p_size"), anchors.drop("p_size"), stop=("the", "new"))
    return out.select("id", "match_model", "match_score")


_JACCARD = """
words AS (
  SELECT p_partkey AS id, p_brand AS fam, p_size, list_sort(list_distinct(list_filter(string_split(p_name || ' ' || lower(p_type), ' '), lambda w: length(w) >= 3 AND w NOT IN ('the', 'new')))) AS t FROM part),
anchors AS (SELECT fam, t, min(id) AS id FROM words WHERE p_size > 35 GROUP BY 1, 2),
sets AS (SELECT DISTINCT fam, t FROM words),
scored AS (
  SELECT s.fam, s.t, a.id AS aid, len(list_intersect(s.t, a.t)) / len(list_distinct(list_concat(s.t, a.t)))::DOUBLE AS score FROM sets s JOIN anchors a ON s.fam = a.fam),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fam, t ORDER BY score DESC, aid) AS rn FROM scored)
SELECT w.id, CASE WHEN round(score, 3) >= 0.45 THEN 'm' || aid END AS match_model, CASE WHEN round(score, 3) >= 0.45 THEN round(score, 3) END AS match_score
FROM words w LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r ON w.fam = r.fam AND w.t = r.t"""


# --- state changes ---------------------------------------------------------------------------------

_CUT = "2024-01-16"
_KEYED = ingest.Policy(last=("last_price", "last_available"))


def _event_offers(spark, sf):
    rows = table(spark, sf, "events")
    return rows.select(
        F.col("event_id").alias("pos"), F.col("user_id").alias("key"), F.when(F.col("event_type") != "signup", F.col("value")).alias("last_price"),
        F.when(F.col("event_type") != "error", 1).otherwise(0).alias("last_available"), F.col("ts").cast("timestamp").alias("ts"),
    )


def _event_state(spark, sf):
    """State before the cut: the newest earlier event of each user up to the 13th of January."""
    early = _event_offers(spark, sf).where(F.col("ts") < stamp("2024-01-01 12:00:00"))
    seen = early.groupBy("key").agg(F.max_by(F.struct("last_price", "last_available", "ts"), "pos").alias("_l"))
    return seen.select(F.col("key").alias("id"), "key", "_l.last_price", "_l.last_available", F.col("_l.ts").alias("first_seen"), F.col("_l.ts").alias("last_seen"))


def _event_batch(spark, sf):
    return _event_offers(spark, sf).where(F.col("ts") >= stamp("2024-01-01 12:00:00")).drop("ts")


def _applied(spark, sf):
    return ingest.apply_offers(_event_state(spark, sf), _event_batch(spark, sf), stamp(_CUT), keys=["key"], policy=_KEYED)


def apply_offers_state(spark, sf):
    state, _, _ = _applied(spark, sf)
    return state.select("id", "key", "last_price", "last_available", show_ts("last_seen").alias("last_seen"))


def apply_offers_changes(spark, sf):
    _, changes, _ = _applied(spark, sf)
    return changes.select("product_id", "pos", "price_old", "price_new", "available_old", "available_new", "change_type")


def change_counters(spark, sf):
    _, _, counters = _applied(spark, sf)
    return counters


_APPLIED = f"""
e AS (
  SELECT event_id AS pos, user_id AS key, CASE WHEN event_type <> 'signup' THEN value END AS price, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS avail, ts FROM events),
st AS (
  SELECT key, arg_max(pos, pos) AS pos FROM e WHERE ts < TIMESTAMP '2024-01-01 12:00:00' GROUP BY key),
state AS (SELECT e.* FROM e JOIN st USING (key, pos)),
batch AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-01 12:00:00'),
seq AS (
  SELECT batch.*, lag(batch.pos) OVER w AS prev_pos, lag(price) OVER w AS lp, lag(avail) OVER w AS la FROM batch WINDOW w AS (PARTITION BY key ORDER BY pos)),
d0 AS (
  SELECT seq.*, s.key IS NULL AND prev_pos IS NULL AS is_new, CASE WHEN prev_pos IS NULL THEN s.price ELSE lp END AS price_old, CASE WHEN prev_pos IS NULL THEN s.avail ELSE la END AS available_old
  FROM seq LEFT JOIN state s USING (key)),
d AS (
  SELECT *, CASE WHEN is_new THEN 'new' WHEN price IS DISTINCT FROM price_old AND avail IS DISTINCT FROM available_old THEN 'both' WHEN price IS DISTINCT FROM price_old THEN 'price'
    WHEN avail IS DISTINCT FROM available_old THEN 'availability' ELSE 'unchanged' END AS change_type FROM d0),
fresh AS (SELECT key, min(pos) AS first_pos FROM batch WHERE key NOT IN (SELECT key FROM state) GROUP BY key),
ids AS (SELECT key, key AS id FROM state UNION ALL SELECT key, (SELECT max(key) FROM state) + row_number() OVER (ORDER BY first_pos, key) FROM fresh),
last_offer AS (SELECT key, arg_max(pos, pos) AS pos FROM batch GROUP BY key)"""


def _ad_sides(spark, sf):
    """Orders before 1999 are stored listings; all orders are seen again at the price of their lines.

    Later orders of a customer share an address with the stored ones, so they are found by it.
    """
    orders = table(spark, sf, "orders")
    url = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("s/"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("a/"), F.col("o_orderkey").cast("string")))
    day = F.col("o_orderdate").cast("timestamp")
    ended = F.when(F.col("o_orderstatus") == "F", day)
    old = F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    state = orders.where(old).select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("U"), F.col("o_orderkey").cast("string")).alias("urn_id"), F.lit("n").alias("name"), F.lit("b").alias("body_text"), F.lit("h").alias("text_hash"),
        url.alias("url"), F.lit("").alias("image_url"), F.lit("city").alias("city"), F.lit("").alias("region"), F.lit("privato").alias("seller_type"), F.lit("p").alias("published_at"),
        day.alias("first_seen"), day.alias("last_seen"), F.when(F.col("o_orderstatus") != "F", day).alias("last_active_seen"), ended.alias("first_inactive_seen"),
        F.col("o_totalprice").alias("last_price"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("last_available"), ended.alias("sold_at"), ended.alias("sold_at_estimated"),
        F.when(F.col("o_orderstatus") == "F", 0.0).alias("sold_window_hours"),
    )
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("p"), F.max("l_linestatus").alias("s"))
    seen = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("pos"), F.concat(F.lit("U"), F.col("o_orderkey").cast("string")).alias("urn_id"), F.lit("new name").alias("name"), F.lit("").alias("body_text"),
        url.alias("url"), F.lit("img").alias("image_url"), F.lit("").alias("city"), F.lit("reg").alias("region"), F.lit("professionale").alias("seller_type"), F.lit("").alias("published_at"),
        F.when(F.col("p") > 50000, F.col("p")).otherwise(F.col("o_totalprice")).alias("last_price"), F.when(F.col("s") == "O", 1).otherwise(0).alias("last_available"),
    )
    return state, seen


_AD_NOW = "2002-01-01"


def _ads_applied(spark, sf):
    return ingest.apply_ads(*_ad_sides(spark, sf), stamp(_AD_NOW))


def apply_ads(spark, sf):
    state, _, _ = _ads_applied(spark, sf)
    times = ("first_seen", "last_seen", "last_active_seen", "first_inactive_seen", "sold_at", "sold_at_estimated")
    return state.select(
        "id", "urn_id", "name", "image_url", "city", "region", "seller_type", "published_at", "last_price", "last_available", "sold_window_hours", "text_hash", *[show_ts(c).alias(c) for c in times]
    )


def apply_ads_changes(spark, sf):
    _, changes, _ = _ads_applied(spark, sf)
    return changes.select("ad_id", "pos", "price_old", "price_new", "available_old", "available_new", "change_type")


def apply_ads_counters(spark, sf):
    return _ads_applied(spark, sf)[2]


def _hash(name, body):
    return f"sha1('{name}' || chr(10) || '{body}')"


_ADS_APPLIED = f"""
o AS (
  SELECT *, 'U' || o_orderkey AS urn, CASE WHEN o_orderpriority = '1-URGENT' THEN 's/' || o_custkey ELSE 'a/' || o_orderkey END AS url, o_orderstatus = 'F' AS gone FROM orders),
state AS (SELECT * FROM o WHERE o_orderdate < TIMESTAMP '1999-01-01'),
seen AS (
  SELECT o.o_orderkey AS pos, urn, url, CASE WHEN p > 50000 THEN p ELSE o_totalprice END AS price, CASE WHEN s = 'O' THEN 1 ELSE 0 END AS avail
  FROM o JOIN (SELECT l_orderkey, max(l_extendedprice) AS p, max(l_linestatus) AS s FROM lineitem GROUP BY 1) x ON o.o_orderkey = l_orderkey),
by_url AS (SELECT url, arg_min(urn, o_orderkey) AS stored FROM state GROUP BY url),
unknown AS (SELECT * FROM seen WHERE urn NOT IN (SELECT urn FROM state)),
leader AS (SELECT url, arg_min(urn, pos) AS leader FROM unknown GROUP BY url),
named AS (
  SELECT seen.*, CASE WHEN seen.urn IN (SELECT urn FROM state) THEN seen.urn ELSE coalesce(b.stored, l.leader) END AS entity
  FROM seen LEFT JOIN by_url b USING (url) LEFT JOIN leader l USING (url)),
seq AS (SELECT *, lag(pos) OVER w AS prev_pos, lag(price) OVER w AS lp, lag(avail) OVER w AS la FROM named WINDOW w AS (PARTITION BY entity ORDER BY pos)),
d0 AS (
  SELECT seq.*, st.urn IS NULL AND prev_pos IS NULL AS is_new, CASE WHEN prev_pos IS NULL THEN st.o_totalprice ELSE lp END AS price_old,
         CASE WHEN prev_pos IS NULL THEN CASE WHEN st.urn IS NULL THEN NULL WHEN st.gone THEN 0 ELSE 1 END ELSE la END AS available_old
  FROM seq LEFT JOIN state st ON seq.entity = st.urn),
d AS (
  SELECT *, CASE WHEN is_new THEN 'new' WHEN price IS DISTINCT FROM price_old AND avail IS DISTINCT FROM available_old THEN 'both' WHEN price IS DISTINCT FROM price_old THEN 'price'
    WHEN avail IS DISTINCT FROM available_old THEN 'availability' ELSE 'unchanged' END AS change_type FROM d0),
agg AS (
  SELECT entity, min(pos) AS first_pos, arg_max(price, pos) AS price, arg_max(avail, pos) AS avail, max(avail) AS was_live, arg_max(urn, pos) FILTER (urn <> entity) AS new_urn
  FROM named GROUP BY entity),
ids AS (
  SELECT urn AS entity, o_orderkey AS id FROM state UNION ALL
  SELECT entity, (SELECT max(o_orderkey) FROM state) + row_number() OVER (ORDER BY first_pos, entity) FROM agg WHERE entity NOT IN (SELECT urn FROM state)),
m AS (
  SELECT ids.id, ids.entity, st.urn IS NULL AS is_new, a.entity IS NOT NULL AS touched, coalesce(a.new_urn, ids.entity) AS urn_id, a.price, a.avail, a.was_live = 1 AS live, st.o_orderdate AS day, st.gone, st.o_totalprice
  FROM ids LEFT JOIN state st ON st.urn = ids.entity LEFT JOIN agg a ON a.entity = ids.entity)"""
_NOW = f"TIMESTAMP '{_AD_NOW}'"
_ADS_STATE = _ADS_APPLIED + f""",
s AS (
  SELECT *, touched AND avail = 0 AS ended, CASE WHEN gone THEN day END AS old_end, CASE WHEN NOT gone THEN day END AS old_active,
         CASE WHEN live OR is_new THEN {_NOW} ELSE day END AS start_at, CASE WHEN live THEN {_NOW} ELSE coalesce(CASE WHEN gone THEN day END, {_NOW}) END AS inactive
  FROM m)
SELECT id, urn_id, CASE WHEN is_new THEN 'new name' ELSE 'n' END AS name, CASE WHEN touched THEN 'img' ELSE '' END AS image_url, CASE WHEN NOT is_new THEN 'city' END AS city,
       CASE WHEN touched THEN 'reg' ELSE '' END AS region, CASE WHEN touched THEN 'professionale' ELSE 'privato' END AS seller_type, CASE WHEN NOT is_new THEN 'p' END AS published_at,
       CASE WHEN touched THEN price ELSE o_totalprice END AS last_price, CASE WHEN touched THEN avail WHEN gone THEN 0 ELSE 1 END AS last_available,
       CASE WHEN ended THEN CASE WHEN old_end IS NOT NULL AND NOT live THEN 0.0 ELSE (epoch_us(inactive) - epoch_us(start_at)) / 3600000000.0::DOUBLE END WHEN NOT touched AND gone THEN 0.0 END AS sold_window_hours,
       CASE WHEN NOT touched THEN 'h' WHEN is_new THEN {_hash('new name', '')} ELSE {_hash('new name', 'b')} END AS text_hash,
       strftime(CASE WHEN is_new THEN {_NOW} ELSE day END, '{_TS}') AS first_seen, strftime(CASE WHEN touched THEN {_NOW} ELSE day END, '{_TS}') AS last_seen,
       strftime(CASE WHEN ended THEN CASE WHEN live THEN {_NOW} ELSE old_active END WHEN touched THEN {_NOW} ELSE old_active END, '{_TS}') AS last_active_seen,
       strftime(CASE WHEN ended THEN inactive WHEN touched THEN NULL ELSE old_end END, '{_TS}') AS first_inactive_seen,
       strftime(CASE WHEN ended THEN CASE WHEN live THEN {_NOW} ELSE coalesce(old_end, {_NOW}) END WHEN touched THEN NULL ELSE old_end END, '{_TS}') AS sold_at,
       strftime(CASE WHEN ended THEN CASE WHEN old_end IS NOT NULL AND NOT live THEN old_end ELSE make_timestamp(epoch_us(start_at) + (epoch_us(inactive) - epoch_us(start_at)) // 2) END WHEN touched THEN NULL ELSE old_end END, '{_TS}') AS sold_at_estimated
FROM s"""


def _sold_sides(spark, sf):
    state, seen = _ad_sides(spark, sf)
    stored = state.select("id", F.col("urn_id").alias("item_id"), "name", F.lit("q").alias("query_label"), F.col("last_price").alias("sold_price"), F.lit("d").alias("sold_date"), "url", "first_seen", "last_seen")
    offers = seen.select("pos", F.col("urn_id").alias("item_id"), "name", F.lit("q2").alias("query_label"), F.col("last_price").alias("sold_price"), F.lit("").alias("sold_date"), "url")
    return stored, offers


def apply_sold(spark, sf):
    state, _, _ = ingest.apply_sold(*_sold_sides(spark, sf), stamp(_AD_NOW))
    return state.select("id", "item_id", "name", "query_label", "sold_price", "sold_date", show_ts("last_seen").alias("last_seen"))


def apply_sold_changes(spark, sf):
    _, changes, _ = ingest.apply_sold(*_sold_sides(spark, sf), stamp(_AD_NOW))
    return changes.select("item_id", "pos", "price_old", "price_new")


def prune_stale(spark, sf):
    rows = products(spark, sf)
    log = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("product_id"), "l_orderkey", "l_linenumber")
    kept, _ = ingest.prune_stale(rows, log)
    return kept.select("id", "source", show_ts("last_seen").alias("last_seen"))


def prune_stale_log(spark, sf):
    rows = products(spark, sf)
    log = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("product_id"), "l_orderkey", "l_linenumber")
    _, kept = ingest.prune_stale(rows, log)
    return kept.groupBy("product_id").agg(F.count("*").alias("rows"))


def count_stale(spark, sf):
    return ingest.count_stale(products(spark, sf))


_STALE = PRODUCTS_SQL + ", newest AS (SELECT source, max(last_seen) AS newest FROM products GROUP BY 1)"


def orphans(spark, sf):
    """Order lines whose order is missing from the orders placed before 1998."""
    kept = table(spark, sf, "orders").where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.orphans(lines, kept, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("rows"))


def cascade_delete(spark, sf):
    ids = table(spark, sf, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("seller"), "o_orderkey")
    kept, log = joins.cascade_delete(people, rows, ids, "seller")
    return kept.agg(F.lit("customers").alias("table"), F.count("*").alias("rows")).unionByName(log.agg(F.lit("orders").alias("table"), F.count("*").alias("rows")))


def constraints(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("last_price"), F.when(F.col("c_nationkey") < 2, F.col("c_nationkey")).when(F.col("c_nationkey") > 20, 7).alias("last_available"))
    return filters.check_constraints(rows, ["last_price"], ["last_available"]).select("id", "violation")


def invalid_rows(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract("text", r"(\d{3,})", 1).alias("name"), F.when(F.col("lang") != "de", F.col("source")).alias("source"))
    return filters.invalid_rows(rows, ["name", "source"]).select("id")


def valid_rows(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract("text", r"(\d{3,})", 1).alias("name"), F.when(F.col("lang") != "de", F.col("source")).alias("source"))
    return filters.valid_rows(rows, ["name", "source"])


def refilter(spark, sf):
    rows = products(spark, sf).select("id", "name", F.col("condition").alias("console_family"), "last_price", "last_available")
    return ingest.refilter(rows, "old|rod", r"red|blue|small|large|old|hot", {"PROMO": 2000.0, "SMALL": 1500.0}).select("id", "last_available")


# --- change logs -------------------------------------------------------------------------------------

def recent_changes(spark, sf):
    log = change_log(spark, sf)
    people = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    joined = joins.changes_with_entity(filters.recent(log, "changed_at", stamp("2024-01-30"), 5), people, "product_id", "c_custkey")
    return joined.select("id", "product_id", "c_name", "c_mktsegment", "price_new", "change_type")


def price_history(spark, sf):
    return statistics.price_history(change_log(spark, sf)).select("product_id", show_ts("changed_at").alias("changed_at"), "price_new", "available_new")


def _stepped(spark, sf):
    log = change_log(spark, sf)
    return previous_row(log, ["product_id"], ["changed_at", "id"], ["price_new"]).withColumnRenamed("prev_price_new", "price_old").drop("has_prev")


def price_timeline(spark, sf):
    return statistics.price_timeline(_stepped(spark, sf)).select("id", "product_id", "price_new", "price_step")


_STEPPED = LOG_SQL + ", stepped AS (SELECT *, lag(price_new) OVER (PARTITION BY product_id ORDER BY changed_at, id) AS price_old FROM log)"


def ad_history(spark, sf):
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return joins.entity_history(people, change_log(spark, sf), "name", "Customer#000000005", "product_id").select("id", "name", "price_new", "change_type")


def attempts_of(spark, sf):
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("ad_id"), F.col("conv_id").alias("run_id"), F.col("turn").alias("step_number"), "role")
    return joins.attempts_of(rows, 3)


# --- snapshots ---------------------------------------------------------------------------------------

def _snapshots(spark, sf):
    """Shipping days as snapshot files of their brand; the products are the lines shipped that month."""
    rows = fact(spark, sf).select(F.col("console_family").alias("file_source"), F.concat("console_family", F.lit("_"), F.date_format("ts", "yyyy-MM")).alias("file"), "source", "price", "available")
    return rows


def _snapshot_heads(spark, sf):
    return _snapshots(spark, sf).groupBy("file_source", "file").agg(
        F.count("*").alias("total"), F.sum((F.col("price") > 5000).cast("long")).alias("full"), F.max("file").alias("scraped_at")
    )


_HEADS = FACT_SQL + """,
heads AS (
  SELECT console_family AS file_source, console_family || '_' || strftime(ts, '%Y-%m') AS file, count(*) AS total, count(*) FILTER (price > 5000) AS full_n
  FROM fact GROUP BY 1, 2)"""


def latest_snapshot(spark, sf):
    return snapshots.latest_snapshot(_snapshot_heads(spark, sf), F.col("full"))


def sources_meta(spark, sf):
    config = table(spark, sf, "region").select(F.concat(F.lit("Brand#"), (F.col("r_regionkey") + 1).cast("string")).alias("id"), F.col("r_name").alias("label"), F.lit("#fff").alias("color"), F.lit(True).alias("enabled"))
    return snapshots.sources_meta(_snapshot_heads(spark, sf), config, F.col("full"))


def retain_latest(spark, sf):
    kept, _ = snapshots.retain_latest(_snapshot_heads(spark, sf), 12)
    return kept.select("file_source", "file", "total")


def archive_split(spark, sf):
    heads = _snapshot_heads(spark, sf).withColumn("taken", F.to_timestamp(F.concat(F.substring_index("file", "_", -1), F.lit("-01")), "yyyy-MM-dd"))
    _, old = snapshots.archive_older_than(heads, F.col("taken"), stamp("2001-01-01"), 365)
    return old.select("file")


def combined_latest(spark, sf):
    """Lines of the latest month of every brand."""
    rows = _snapshots(spark, sf)
    chosen = snapshots.latest_snapshot(_snapshot_heads(spark, sf), F.col("full")).select("file")
    return rows.join(chosen, "file", "left_semi").groupBy("file_source", "file").agg(F.count("*").alias("rows"), F.sum("available").alias("available"))


def consistency_check(spark, sf):
    rows = _snapshots(spark, sf)
    chosen = snapshots.latest_snapshot(_snapshot_heads(spark, sf), F.col("full")).select("file")
    shown = rows.join(chosen, "file", "left_semi").select(F.col("file_source").alias("source"))
    stored = table(spark, sf, "part").select(F.col("p_brand").alias("source"))
    return joins.consistency_check(stored, shown)


def table_counts(spark, sf):
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark")
    return aggregates.table_counts({n: table(spark, sf, n) for n in names})


def run_summary(spark, sf):
    stores = {"cex": "cex", "ebay": "ebay", "subito": "subito"}
    rows = fact(spark, sf).select(lookup(stores, F.col("source")).alias("source"), F.lit(1).alias("total"), F.col("available").alias("new"))
    return aggregates.run_summary(rows)


QUERIES = {
    "catalog": (
        catalog_view,
        "SELECT p_partkey AS id, p_name AS name, p_type AS category, p_size || ' GB' AS storage_label FROM part",
    ),
    "base_models": (base_models, "SELECT p_partkey AS id, p_name AS name, p_type AS category, p_size || ' GB' AS storage_label FROM part WHERE p_retailprice < 950"),
    "dimensions": (
        dimensions,
        "SELECT DISTINCT CAST(CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END AS BIGINT) AS id, p_type AS value FROM part UNION ALL SELECT DISTINCT CAST(p_size AS BIGINT), p_size || ' GB' FROM part",
    ),
    "get_or_create_dim": (
        get_or_create_dim,
        "WITH known AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS label FROM nation WHERE n_regionkey = 0), seen AS (SELECT n_name AS label, min(c_custkey) AS f FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name NOT IN (SELECT label FROM known) GROUP BY 1) SELECT id, label FROM known UNION ALL SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY f, label), label FROM seen",
    ),
    "standard_groups": (standard_groups, f"WITH {_NAMED} SELECT standard_key, standard_name, total_products, sources, packaging_states, conditions FROM groups"),
    "standard_group_items": (standard_group_items, f"WITH {_NAMED} SELECT DISTINCT standard_key, source, name, packaging AS packaging_state, condition FROM named"),
    "filter_standard_groups": (
        filter_standard_groups,
        f"WITH {_NAMED} SELECT standard_key, standard_name, total_products FROM groups g WHERE lower(standard_name) LIKE '%red w%' OR lower(standard_key) LIKE '%red w%' OR standard_key IN (SELECT standard_key FROM named WHERE lower(name) LIKE '%red w%')",
    ),
    "search_groups": (
        search_groups,
        f"WITH {PRODUCTS_SQL}, n AS (SELECT *, CASE WHEN size > 10 THEN upper(name) END AS sn, CASE WHEN size > 30 THEN name || '|' || condition END AS sk FROM products) SELECT coalesce(sk, sn, name) AS group_key, count(*) AS hits, min(coalesce(last_price, 0)) AS lowest, first(sn ORDER BY id) AS group_name FROM n GROUP BY 1",
    ),
    "search": (
        search,
        f"WITH {PRODUCTS_SQL} SELECT id, upper(name) AS standard_name, last_price FROM products WHERE lower(condition) IN ('promo', 'small', 'economy') AND (name LIKE 'red %' OR name LIKE '% red') AND name LIKE '%ring%' AND last_available = 1",
    ),
    "facet_filter": (
        facet_filter,
        f"WITH {PRODUCTS_SQL} SELECT id, name, last_price FROM products WHERE name LIKE '%r%' AND (lower(condition) LIKE '%prom%' OR lower(condition) LIKE '%econ%') AND condition IN ('PROMO', 'ECONOMY', 'LARGE') AND string_split(name, ' ')[1] IN ('red', 'blue', 'small') AND lower(condition) = 'promo' AND last_available = 1 AND size > 5",
    ),
    "edition_facets": (edition_facets, "SELECT p_name AS edition, count(*) AS count FROM part WHERE p_type <> 'STANDARD' GROUP BY 1"),
    "combo_groups": (
        combo_groups,
        f"WITH {_COMBOS} SELECT combo_key, count(*) AS count, min(price) AS min_price, max(price) AS max_price, any_value(parsed_family) AS parsed_family, any_value(parsed_segment) AS parsed_segment FROM items GROUP BY 1",
    ),
    "combo_groups_other": (combo_groups_other, f"WITH {_COMBOS} SELECT combo_key, count(*) AS count, min(price) AS min_price, max(price) AS max_price FROM others GROUP BY 1"),
    "model_grid": (
        model_grid,
        f"WITH {_COMBOS}, c AS (SELECT combo_key, any_value(parsed_family) AS family, any_value(parsed_segment) AS segment, bool_or(available = 1) AS live, count(*) FILTER (available = 1) AS n, min(price) AS lo, max(price) AS hi FROM items GROUP BY 1) SELECT family, segment, count(*) FILTER (live) AS combos_available, count(*) AS combos_total, min(lo) AS min_price, max(hi) AS max_price, CAST(sum(n) AS BIGINT) AS offers_available FROM c GROUP BY 1, 2",
    ),
    "overrides": (
        overrides,
        "SELECT p_partkey AS display_id, CASE WHEN s_acctbal > 0 THEN '1 TB' ELSE p_size || ' GB' END AS storage_label, CASE WHEN s_acctbal > 5000 THEN 'Nero' END AS fixed_color FROM part LEFT JOIN supplier ON p_partkey = s_suppkey * 3",
    ),
    "parsed_view": (parsed_view, _parsed_sql()),
    "display_ids": (
        display_ids,
        "WITH r AS (SELECT p_partkey AS id, CASE WHEN CAST(substr(p_brand, 7) AS BIGINT) < 20 THEN CAST(substr(p_brand, 7) AS BIGINT) ELSE 99 END AS prefix, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, CASE p_type WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 1 ELSE 9 END, lower(p_type), p_partkey) AS rn FROM part) SELECT id, prefix * 100000 + rn AS display_id, rn < 100000 AS rank_fits FROM r",
    ),
    "dedupe_first": (
        dedupe_first,
        "WITH k AS (SELECT o_orderkey AS pos, coalesce(CASE WHEN o_orderstatus = 'O' THEN 'C' || o_custkey END, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || o_custkey END, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END) AS key FROM orders) SELECT min(pos) AS pos FROM k WHERE key IS NOT NULL GROUP BY key",
    ),
    "dedupe_merge": (
        dedupe_merge,
        f"WITH {_MERGED} SELECT id, source, sku, last_price, last_available, is_base_model, strftime(first_seen, '{_TS}') AS first_seen, strftime(last_seen, '{_TS}') AS last_seen FROM folded",
    ),
    "dedupe_moves": (dedupe_moves, f"WITH {_MERGED} SELECT k.id AS old_id, f.id AS new_id FROM keyed k JOIN folded f USING (grp) WHERE k.id <> f.id"),
    "normalize_conditions": (
        normalize_conditions,
        f"WITH {_CONDITIONS} SELECT first(id ORDER BY CASE WHEN condition = want THEN 0 ELSE 1 END, id) AS id, source, name, want AS condition, max(is_base_model) AS is_base_model, strftime(min(first_seen), '{_TS}') AS first_seen FROM wanted GROUP BY source, name, want",
    ),
    "nearest_price": (nearest_price, f"WITH {_NEAREST}"),
    "additive_merge_parent": (additive_merge_parent, f"WITH {_ADDITIVE} SELECT id, o_custkey AS seller, o_orderpriority AS kind, o_totalprice AS price FROM numbered"),
    "additive_merge_child": (additive_merge_child, f"WITH {_ADDITIVE} SELECT id AS ad_id, count(*) AS rows, sum(l_quantity) AS quantity FROM numbered JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"),
    "insert_or_ignore": (
        insert_or_ignore,
        f"WITH {_ADDITIVE} SELECT o_orderkey AS id, o_custkey AS seller, o_orderpriority AS kind FROM here UNION ALL SELECT o_orderkey, o_custkey, o_orderpriority FROM fresh",
    ),
    "jaccard_match": (jaccard_match, f"WITH {_JACCARD}"),
    "apply_offers_state": (
        apply_offers_state,
        f"WITH {_APPLIED} SELECT ids.id, ids.key, CASE WHEN l.pos IS NULL THEN s.price ELSE b.price END AS last_price, CASE WHEN l.pos IS NULL THEN s.avail ELSE b.avail END AS last_available, strftime(CASE WHEN l.pos IS NULL THEN s.ts ELSE TIMESTAMP '{_CUT}' END, '{_TS}') AS last_seen FROM ids LEFT JOIN state s ON s.key = ids.key LEFT JOIN last_offer l ON l.key = ids.key LEFT JOIN batch b ON b.pos = l.pos",
    ),
    "apply_offers_changes": (
        apply_offers_changes,
        f"WITH {_APPLIED} SELECT ids.id AS product_id, pos, price_old, price AS price_new, available_old, avail AS available_new, change_type FROM d JOIN ids USING (key) WHERE change_type <> 'unchanged'",
    ),
    "change_counters": (
        change_counters,
        f"WITH {_APPLIED} SELECT count(*) FILTER (change_type = 'new') AS new, count(*) FILTER (change_type IN ('price', 'both')) AS price_changes, count(*) FILTER (change_type IN ('availability', 'both')) AS avail_changes, count(*) FILTER (change_type = 'unchanged') AS unchanged FROM d",
    ),
    "apply_ads": (apply_ads, f"WITH {_ADS_STATE}"),
    "apply_ads_changes": (
        apply_ads_changes,
        f"WITH {_ADS_APPLIED} SELECT ids.id AS ad_id, pos, price_old, price AS price_new, available_old, avail AS available_new, change_type FROM d JOIN ids USING (entity) WHERE change_type <> 'unchanged'",
    ),
    "apply_ads_counters": (
        apply_ads_counters,
        f"WITH {_ADS_APPLIED} SELECT count(*) FILTER (change_type = 'new') AS new, count(*) FILTER (change_type IN ('price', 'both')) AS price_changes, count(*) FILTER (change_type IN ('availability', 'both')) AS avail_changes, count(*) FILTER (change_type = 'unchanged') AS unchanged FROM d",
    ),
    "apply_sold": (
        apply_sold,
        f"WITH {_ADS_APPLIED} SELECT id, urn_id AS item_id, CASE WHEN is_new THEN 'new name' ELSE 'n' END AS name, CASE WHEN is_new THEN 'q2' ELSE 'q' END AS query_label, CASE WHEN touched THEN price ELSE o_totalprice END AS sold_price, CASE WHEN NOT is_new THEN 'd' END AS sold_date, strftime(CASE WHEN touched THEN {_NOW} ELSE day END, '{_TS}') AS last_seen FROM m",
    ),
    "apply_sold_changes": (
        apply_sold_changes,
        f"WITH {_ADS_APPLIED} SELECT ids.id AS item_id, pos, price_old, price AS price_new FROM d JOIN ids USING (entity) WHERE change_type IN ('price', 'both')",
    ),
    "prune_stale": (
        prune_stale,
        f"WITH {_STALE} SELECT id, source, strftime(last_seen, '{_TS}') AS last_seen FROM products JOIN newest USING (source) WHERE last_seen IS NULL OR NOT last_seen < newest",
    ),
    "prune_stale_log": (
        prune_stale_log,
        f"WITH {_STALE} SELECT l_partkey AS product_id, count(*) AS rows FROM lineitem WHERE l_partkey IN (SELECT id FROM products JOIN newest USING (source) WHERE last_seen IS NULL OR NOT last_seen < newest) GROUP BY 1",
    ),
    "count_stale": (count_stale, f"WITH {_STALE} SELECT source, count(*) AS stale_rows FROM products JOIN newest USING (source) WHERE last_seen < newest GROUP BY 1"),
    "orphans": (orphans, "SELECT l_orderkey, count(*) AS rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') GROUP BY 1"),
    "cascade_delete": (
        cascade_delete,
        "SELECT 'customers' AS \"table\", count(*) AS rows FROM customer WHERE NOT c_acctbal < 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    ),
    "constraints": (
        constraints,
        "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'last_price negative' WHEN c_nationkey > 20 THEN 'last_available not 0/1' END AS violation FROM customer",
    ),
    "invalid_rows": (invalid_rows, "SELECT doc_id AS id FROM documents WHERE regexp_extract(text, '(\\d{3,})', 1) = '' OR lang = 'de'"),
    "valid_rows": (valid_rows, "SELECT doc_id AS id, regexp_extract(text, '(\\d{3,})', 1) AS name, source FROM documents WHERE regexp_extract(text, '(\\d{3,})', 1) <> '' AND lang <> 'de'"),
    "refilter": (
        refilter,
        f"WITH {PRODUCTS_SQL} SELECT id, CASE WHEN last_available = 1 AND (regexp_matches(name, 'old|rod') OR NOT regexp_matches(name, 'red|blue|small|large|old|hot') OR last_price < CASE condition WHEN 'PROMO' THEN 2000 WHEN 'SMALL' THEN 1500 ELSE 8 END) THEN 0 ELSE last_available END AS last_available FROM products",
    ),
    "recent_changes": (
        recent_changes,
        f"WITH {LOG_SQL} SELECT id, product_id, c_name, c_mktsegment, price_new, change_type FROM log JOIN customer ON product_id = c_custkey WHERE changed_at >= DATE '2024-01-25'",
    ),
    "price_history": (price_history, f"WITH {LOG_SQL} SELECT product_id, strftime(changed_at, '{_TS}') AS changed_at, price_new, available_new FROM log WHERE change_type IN ('new', 'price', 'availability')"),
    "price_timeline": (
        price_timeline,
        f"WITH {_STEPPED} SELECT id, product_id, price_new, CASE WHEN change_type IN ('price', 'both') AND price_old IS NOT NULL THEN price_new - price_old END AS price_step FROM stepped WHERE change_type IN ('new', 'price', 'both') AND price_new IS NOT NULL",
    ),
    "ad_history": (ad_history, f"WITH {LOG_SQL} SELECT id, c_name AS name, price_new, change_type FROM log JOIN customer ON product_id = c_custkey WHERE c_name = 'Customer#000000005'"),
    "attempts_of": (attempts_of, "SELECT conv_id * 1000 + turn AS id, conv_id AS ad_id, conv_id AS run_id, turn AS step_number, role FROM conversations WHERE conv_id = 3"),
    "latest_snapshot": (latest_snapshot, f"WITH {_HEADS} SELECT file_source, first(file ORDER BY CASE WHEN full_n > 0 THEN 0 ELSE 1 END, file DESC) AS file FROM heads GROUP BY 1"),
    "sources_meta": (
        sources_meta,
        f"WITH {_HEADS}, m AS (SELECT file_source, count(*) AS snapshots, first(file ORDER BY CASE WHEN full_n > 0 THEN 0 ELSE 1 END, file DESC) AS last_scraped, first(total ORDER BY CASE WHEN full_n > 0 THEN 0 ELSE 1 END, file DESC) AS last_total FROM heads GROUP BY 1) SELECT file_source AS id, coalesce(r_name, file_source) AS label, CASE WHEN r_name IS NULL THEN '#888' ELSE '#fff' END AS color, true AS enabled, snapshots, last_scraped, last_total FROM m LEFT JOIN region ON file_source = 'Brand#' || (r_regionkey + 1)",
    ),
    "retain_latest": (retain_latest, f"WITH {_HEADS}, r AS (SELECT *, row_number() OVER (PARTITION BY file_source ORDER BY file DESC) AS rn FROM heads) SELECT file_source, file, total FROM r WHERE rn <= 12"),
    "archive_split": (archive_split, f"WITH {_HEADS} SELECT file FROM heads WHERE CAST(string_split(file, '_')[2] || '-01' AS TIMESTAMP) < TIMESTAMP '2001-01-01' - INTERVAL 365 DAY"),
    "combined_latest": (
        combined_latest,
        f"WITH {_HEADS}, c AS (SELECT file_source, first(file ORDER BY CASE WHEN full_n > 0 THEN 0 ELSE 1 END, file DESC) AS file FROM heads GROUP BY 1) SELECT console_family AS file_source, c.file, count(*) AS rows, CAST(sum(available) AS BIGINT) AS available FROM fact JOIN c ON c.file = console_family || '_' || strftime(ts, '%Y-%m') GROUP BY 1, 2",
    ),
    "consistency_check": (
        consistency_check,
        f"WITH {_HEADS}, c AS (SELECT first(file ORDER BY CASE WHEN full_n > 0 THEN 0 ELSE 1 END, file DESC) AS file FROM heads GROUP BY file_source), shown AS (SELECT lower(console_family) AS source, count(*) AS n FROM fact WHERE console_family || '_' || strftime(ts, '%Y-%m') IN (SELECT file FROM c) GROUP BY 1), stored AS (SELECT lower(p_brand) AS source, count(*) AS n FROM part GROUP BY 1) SELECT coalesce(shown.source, stored.source) AS source, coalesce(stored.n, 0) AS in_table, coalesce(shown.n, 0) AS in_snapshot, coalesce(stored.n, 0) = coalesce(shown.n, 0) AS consistent FROM stored FULL JOIN shown ON stored.source = shown.source",
    ),
    "table_counts": (
        table_counts,
        " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark")),
    ),
    "run_summary": (
        run_summary,
        f"WITH {FACT_SQL} SELECT source, count(*) AS total, CAST(sum(available) AS BIGINT) AS new, CASE source WHEN 'cex' THEN 4 WHEN 'subito' THEN 5 ELSE 6 END AS rank FROM fact GROUP BY 1",
    ),
}
