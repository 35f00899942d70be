"""Titles, texts, pages and raw records."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.bindings.roles import table
from marketlens.catalog import CONSOLE_PATTERNS, STOP_TOKENS, Entry, ModelRule, TitleRules
from marketlens.functions import money, text, titles, urls
from marketlens.operators import filters, joins
from marketlens.plans import cascade, classify
from marketlens.sources import listings, pages

# --- a rule set over the words of part names -----------------------------------------------------


PART_RULES = TitleRules(
    families=(("red", r"\bred\b", 3), ("blue", r"\bblue\b", 2), ("hot", r"\bhot\b", 1), ("ring", r"\bring\b", 4)),
    bare_family=(r"\bbolt\b", "bolt"),
    models={
        "red": ModelRule((("W", r"\bwidget\b"), ("R", r"\b(ring|rod)\b")), "Plain"),
        "blue": ModelRule((("W", r"\bwidget\b"), ("R", r"\bring\b")), "Plain", True),
        "ring": ModelRule((), "Plain"),
    },
    aliases={"promo": ("red", "W"), "large": ("blue", None)},
    family_of_label={"red": "red", "blue": "blue", "ring": "ring"},
    sub_models={"w": "Widget", "r": "Round"},
    patterns={
        **CONSOLE_PATTERNS, "limited": r"\bplate\b", "special": r"\bgear\b", "bundle": r"\banvil\b", "premium": r"\bring\b", "digital": r"\bsmall\b", "noise": r"\b(old|new)\b",
    },
    editions=(("Plate", r"\bplate\b"), ("Gear", r"\bgear\b")),
    colors=(("Hot", r"\bhot\b"), ("Cold", r"\bcold\b"), ("Old", r"\bold\b")),
    family_titles={"red": "Red things"},
    catalogue=(
        Entry("1", False, "Red", "W", "8 GB", "x"), Entry("2", True, "Red", "W", "16 GB", "widget"), Entry("3", False, "Red", "R", "8 GB", "rod"),
        Entry("4", True, "Red", "R", "8 GB", "ring"), Entry("5", False, "Blue", "R", "8 GB", "y"), Entry("6", False, "Ring", "Plain", "8 GB", "z"),
        Entry("7", True, "Ring", "Plain", "8 GB", "small digital"),
    ),
    product="PART", label_prefix="Part", method="rules:parts", default_title="Part",
)


def _parts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))


def family_detect(spark, sf):
    return _parts(spark, sf).select("id", titles.detect_family(F.col("name"), PART_RULES).alias("family"))


# Position of a word in a two-word name; 0 when absent.
def _pos(w: str) -> str:
    return f"strpos(' ' || name || ' ', ' {w} ')"


_FAMILY_SQL = f"""
parts AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind FROM part),
hits AS (
  SELECT id, name, kind, list_filter([
    {{'pos': {_pos('red')}, 'tie': -3, 'key': 'red'}}, {{'pos': {_pos('blue')}, 'tie': -2, 'key': 'blue'}},
    {{'pos': {_pos('hot')}, 'tie': -1, 'key': 'hot'}}, {{'pos': {_pos('ring')}, 'tie': -4, 'key': 'ring'}}], lambda h: h.pos > 0) AS h
  FROM parts),
fam AS (
  SELECT id, name, kind, CASE WHEN len(h) > 0 THEN list_sort(h)[1].key WHEN {_pos('bolt')} > 0 THEN 'bolt' ELSE 'other' END AS family FROM hits)"""
_MODEL_SQL = _FAMILY_SQL + f""",
mod AS (
  SELECT *, CASE family WHEN 'red' THEN CASE WHEN {_pos('widget')} > 0 THEN 'W' WHEN {_pos('ring')} > 0 OR {_pos('rod')} > 0 THEN 'R' ELSE 'Plain' END
    WHEN 'blue' THEN CASE WHEN {_pos('widget')} > 0 THEN 'W' WHEN {_pos('ring')} > 0 THEN 'R' ELSE 'Plain' END WHEN 'ring' THEN 'Plain' ELSE 'Unknown' END AS model FROM fam),
rowed AS (
  SELECT *, CASE WHEN family = 'red' AND model = 'W' THEN '2' WHEN family = 'red' AND model = 'R' THEN CASE WHEN {_pos('ring')} > 0 THEN '4' ELSE '3' END
    WHEN family = 'blue' AND model = 'R' THEN '5' WHEN family = 'ring' THEN CASE WHEN {_pos('small')} > 0 THEN '7' ELSE '6' END END AS cid FROM mod),
classed AS (
  SELECT *, CASE WHEN cid IN ('2', '4', '7') THEN 'special' WHEN cid IS NOT NULL THEN 'standard' WHEN {_pos('anvil')} > 0 THEN 'bundle' WHEN {_pos('plate')} > 0 THEN 'limited'
    WHEN {_pos('gear')} > 0 THEN 'special' ELSE 'standard' END AS edition FROM rowed),
full_class AS (
  SELECT *, CASE WHEN family = 'other' OR cid IS NULL THEN 'unknown' WHEN edition <> 'standard' OR {_pos('ring')} > 0 THEN 'premium' ELSE 'base' END AS segment,
         CASE model WHEN 'W' THEN 'Widget' WHEN 'R' THEN 'Round' ELSE model END AS sub FROM classed)"""


def classify_titles(spark, sf):
    out = classify.classify_titles(_parts(spark, sf), "name", None, PART_RULES)
    return out.select("id", *classify.CLASS_COLUMNS)


def classify_with_hint(spark, sf):
    rows = _parts(spark, sf).withColumn("kind", F.lower("kind"))
    out = classify.classify_titles(rows, "name", "kind", PART_RULES)
    return out.groupBy("console_family", "sub_model", "canonical_model").agg(F.count("*").alias("rows"))


def _hint_sql() -> str:
    return _FAMILY_SQL + f""",
hf AS (SELECT id, name, kind, CASE kind WHEN 'PROMO' THEN 'red' WHEN 'LARGE' THEN 'blue' ELSE lower(kind) END AS family FROM parts),
hm AS (
  SELECT *, CASE family WHEN 'red' THEN CASE WHEN {_pos('widget')} > 0 THEN 'W' WHEN {_pos('ring')} > 0 OR {_pos('rod')} > 0 THEN 'R' ELSE 'Plain' END
    WHEN 'blue' THEN CASE WHEN {_pos('widget')} > 0 THEN 'W' WHEN {_pos('ring')} > 0 THEN 'R' ELSE 'Plain' END ELSE 'Unknown' END AS model FROM hf),
hc AS (
  SELECT *, CASE WHEN family = 'red' AND model = 'W' THEN '2' WHEN family = 'red' AND model = 'R' THEN CASE WHEN {_pos('ring')} > 0 THEN '4' ELSE '3' END
    WHEN family = 'blue' AND model = 'R' THEN '5' ELSE 'unknown' END AS cid FROM hm)
SELECT family AS console_family, CASE model WHEN 'W' THEN 'Widget' WHEN 'R' THEN 'Round' ELSE model END AS sub_model, cid AS canonical_model, count(*) AS rows FROM hc GROUP BY 1, 2, 3"""


def standardize_titles(spark, sf):
    classed = classify.classify_titles(_parts(spark, sf), "name", None, PART_RULES)
    return classify.standardize_titles(classed, "name", PART_RULES).select("id", "standard_name", "standard_key")


_STANDARD_SQL = _MODEL_SQL + f""",
bare AS (SELECT *, trim(regexp_replace(regexp_replace(name, '\\b(old|new)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS b FROM full_class),
titled AS (
  SELECT *, CASE cid WHEN '2' THEN 'Part Red W 16 GB - widget' WHEN '3' THEN 'Part Red R 8 GB - rod' WHEN '4' THEN 'Part Red R 8 GB - ring' WHEN '5' THEN 'Part Blue R 8 GB - y'
    WHEN '6' THEN 'Part Ring Plain 8 GB - z' WHEN '7' THEN 'Part Ring Plain 8 GB - small digital'
    ELSE array_to_string(list_transform(string_split(b, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS base0 FROM bare),
dig AS (SELECT *, {_pos('small')} > 0 AS digital, CASE WHEN {_pos('plate')} > 0 THEN 'Plate' WHEN {_pos('gear')} > 0 THEN 'Gear' END AS ed_named,
    CASE WHEN {_pos('hot')} > 0 THEN 'Hot' WHEN {_pos('cold')} > 0 THEN 'Cold' WHEN {_pos('old')} > 0 THEN 'Old' END AS shade FROM titled),
based AS (SELECT *, base0 || CASE WHEN digital AND lower(base0) NOT LIKE '%digital%' THEN ' Digital' ELSE '' END AS base FROM dig)
SELECT id, CASE WHEN cid IS NOT NULL THEN base ELSE base || coalesce(' [' || ed_named || ']', '') || coalesce(' - ' || shade, '') END AS standard_name,
       coalesce(cid, replace(lower(base), ' ', '-')) || '|' || CASE WHEN digital THEN 'digital' ELSE 'standard' END || '|' ||
       CASE WHEN cid IS NOT NULL THEN edition WHEN ed_named IS NOT NULL THEN lower(ed_named) ELSE 'standard' END AS standard_key
FROM based"""


def search_attributes(spark, sf):
    return classify.search_attributes(_parts(spark, sf), "name", PART_RULES).select("id", "edition_name", "color", "has_kinect")


def _ruled(spark, sf):
    rows = table(spark, sf, "part")
    ads = rows.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lower("p_type").alias("body_text"), F.lit(None).cast("string").alias("console_family"))
    anchors = rows.where(F.col("p_size") > 40).select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"), F.lit("red").alias("console_family"), F.col("p_brand").alias("canonical_model")
    )
    return classify.rules_and_anchor_pass(ads, anchors, PART_RULES)


def rules_and_anchor_pass(spark, sf):
    out, _ = _ruled(spark, sf)
    return out.groupBy("console_family", "canonical_model", "classify_method").agg(F.count("*").alias("rows"), F.max("classify_confidence").alias("confidence"))


def rules_open_rows(spark, sf):
    """Rows that rules and anchors leave to a model."""
    _, left = _ruled(spark, sf)
    return left.select("id", "console_family", "model_segment", "classify_confidence")


def rule_results(spark, sf):
    """The rule pass written back to the listings it was made for, with its version; all others keep what they had."""
    before = {c: F.lit("before") for c in ("console_family", "model_segment", "edition_class", "canonical_model", "classify_method", "classify_version")}
    state = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size").withColumns(before).withColumn("classify_confidence", F.lit(0.1))
    out, _ = _ruled(spark, sf)
    wanted = out.join(state.where(F.col("p_size") > 10).select("id"), "id", "left_semi")
    return cascade.apply_rule_results(state, wanted, "rules:v3").drop("p_size")


_STOPPED = ", ".join(f"'{w}'" for w in STOP_TOKENS)
_RULED = _MODEL_SQL.replace("p_name AS name", "p_name || ' ' || lower(p_type) AS name").lstrip() + f""",
word_sets AS (
  SELECT p_partkey AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(p_name, '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOPPED})))) AS t,
         list_sort(list_distinct(list_filter(regexp_split_to_array(p_name || ' ' || lower(p_type), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOPPED})))) AS anchor, p_size, p_brand FROM part),
anchor_sets AS (SELECT anchor, min(id) AS aid, arg_min(p_brand, id) AS model FROM word_sets WHERE p_size > 40 GROUP BY 1),
asked AS (SELECT DISTINCT t FROM word_sets JOIN full_class USING (id) WHERE family = 'red' AND segment = 'base' AND edition = 'standard'),
weighed AS (SELECT t, aid, model, len(list_intersect(t, anchor)) / len(list_distinct(list_concat(t, anchor)))::DOUBLE AS score FROM asked, anchor_sets),
closest AS (SELECT t, arg_max(model, (score, -aid)) AS model, round_even(max(score), 3) AS score FROM weighed GROUP BY 1 HAVING round_even(max(score), 3) >= 0.45),
passed AS (
  SELECT c.id, family, segment, edition, coalesce(m.model, cid, 'unknown') AS canonical, CASE WHEN m.model IS NULL THEN 'rules:parts' ELSE 'cex-match:v1' END AS method,
         least(1.0::DOUBLE, greatest(CASE segment WHEN 'unknown' THEN 0.35 WHEN 'premium' THEN 0.88 ELSE 0.9 END::DOUBLE, coalesce(0.65::DOUBLE + m.score * 0.3::DOUBLE, 0))) AS confidence
  FROM full_class c JOIN word_sets w USING (id) LEFT JOIN closest m ON m.t = w.t AND family = 'red' AND segment = 'base' AND edition = 'standard')"""


def console_titles(spark, sf):
    """The console rules over every text there is: documents, conversations and part names."""
    docs = table(spark, sf, "documents").select(F.col("text").alias("name"))
    talk = table(spark, sf, "conversations").select(F.col("text").alias("name"))
    parts = table(spark, sf, "part").select(F.concat(F.lit("Console Xbox 360 "), F.col("p_size").cast("string"), F.lit("0 GB "), F.col("p_name")).alias("name"))
    out = classify.classify_titles(docs.unionByName(talk).unionByName(parts))
    return out.groupBy("console_family", "sub_model", "canonical_model", "model_segment").agg(F.count("*").alias("rows"))


# --- text functions over whole documents --------------------------------------------------------------

def text_hash(spark, sf):
    rows = table(spark, sf, "documents")
    return rows.select("doc_id", text.text_hash(F.col("source"), F.col("text")).alias("text_hash"))


_SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def tokens(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.sort_array("t"), " ").cast("binary")).alias("digest"))


def jaccard(spark, sf):
    """Overlap of each document's words with those of the sources' first document."""
    rows = table(spark, sf, "documents").select("doc_id", "source", text.tokens(F.col("text")).alias("t"))
    first = rows.groupBy("source").agg(F.min_by("t", "doc_id").alias("u"))
    return rows.join(first, "source").select("doc_id", text.jaccard(F.col("t"), F.col("u")).alias("score"))


_TOKENS = r"""
tok AS (
  SELECT doc_id, source, list_sort(list_filter(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 3)),
         lambda w: w NOT IN ('xbox', 'console', 'con', 'the', 'and', 'per', 'for', 'edition'))) AS t FROM documents)"""


_CLEANED = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '[<>\"''`]', ' ', 'g'), '[\x00-\x1F\x7F]', ' ', 'g'), '\s{2,}', ' ', 'g'))"
_WEB = f"CASE WHEN regexp_matches({_CLEANED}, '(?i)^https?://') THEN {_CLEANED} ELSE '' END"
_RECORDS = f"""
WITH rows AS (SELECT page_id, url, html, CASE WHEN page_id % 2 = 0 THEN ' HTTPS://a<b ' || url ELSE 'javascript:' || url END AS href, string_split(html, chr(10)) AS lines FROM pages)
SELECT page_id, {_WEB.replace("{}", "href")} AS image_url, md5({_CLEANED.replace("{}", "html")}) AS html, md5(array_to_string(list_transform(lines, lambda l: {_CLEANED.replace("{}", "l")}), chr(10))) AS lines,
       md5(array_to_string(list_transform(lines, lambda l: {_WEB.replace("{}", "l")}), chr(10))) AS line_urls, len(lines) AS n_lines, {_WEB.replace("{}", "url")} AS page_url,
       {_CLEANED.replace("{}", "('`x`  ' || url)")} AS note FROM rows"""


def sanitize(spark, sf):
    rows = table(spark, sf, "pages")
    return rows.select("page_id", F.md5(text.sanitize_text(F.col("html")).cast("binary")).alias("digest"), text.sanitize_url(F.col("url")).alias("url"))


def sanitize_records(spark, sf):
    """Pages as nested records: a link, a list of records of which each has a line and an address, and a map."""
    line = F.transform(F.split("html", "\n"), lambda l: F.struct(l.alias("text"), l.alias("Line_URL")))
    href = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" HTTPS://a<b "), "url")).otherwise(F.concat(F.lit("javascript:"), "url"))
    rows = table(spark, sf, "pages").select(
        "page_id", F.struct(href.alias("image_url"), F.struct("html").alias("inner")).alias("link"), line.alias("lines"),
        F.create_map(F.lit("page_url"), "url", F.lit("note"), F.concat(F.lit("`x`  "), "url")).alias("more"),
    )
    clean = text.sanitize_columns(rows)
    joined = lambda c: F.md5(F.array_join(F.col(c), "\n", "").cast("binary"))
    return clean.select(
        "page_id", F.col("link.image_url").alias("image_url"), F.md5(F.col("link.inner.html").cast("binary")).alias("html"), joined("lines.text").alias("lines"),
        joined("lines.Line_URL").alias("line_urls"), F.size("lines").cast("long").alias("n_lines"), F.col("more")["page_url"].alias("page_url"), F.col("more")["note"].alias("note"),
    )


def input_hash(spark, sf):
    rows = table(spark, sf, "documents")
    return rows.select("doc_id", text.input_hash(F.col("source"), F.col("text"), F.col("n_chars") / F.lit(4.0), "p1", "t1").alias("input_hash"))


def redact(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", text.redact(F.col("text")).alias("clean"))
    return rows.select("doc_id", (F.col("text") != F.col("clean")).alias("changed"), F.length("clean").cast("long").alias("length"))


def shorten(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", text.shorten(F.col("text"), 120).alias("short"))
    return rows


def slugs(spark, sf):
    rows = table(spark, sf, "documents")
    return rows.select("doc_id", text.slug(F.col("text")).alias("slug"), text.region_token(F.col("text")).alias("token"))


_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def title_case(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.title_case(F.concat_ws("-", "p_name", F.lower("p_brand"))).alias("title"))


def clean_price(spark, sf):
    price = F.col("l_extendedprice")
    shown = F.concat(F.replace(F.format_string("%.2f", price), F.lit("."), F.lit(",")), F.lit(" €"))
    grouped = F.concat(F.lit("EUR "), F.translate(F.format_number(price, 2), ",.", ".,"))
    rows = table(spark, sf, "lineitem").select(shown.alias("shown"), grouped.alias("grouped"))
    return rows.select(money.clean_price(F.col("shown")).alias("plain"), money.parse_price_eur(F.col("grouped")).alias("euro"), money.clean_price(F.col("grouped")).alias("both"))


def format_price(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), money.format_price_it(F.col("p_retailprice")).alias("shown"))


def storage_parse(spark, sf):
    unit = F.when(F.col("p_size") > 40, "TB").when(F.col("p_size") > 20, " gb").otherwise(" MB")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Xbox "), "p_name", F.lit(" "), F.col("p_size").cast("string"), unit).alias("name"))
    label = money.storage_label(F.col("name"))
    return rows.select(
        "id", label.alias("label"), money.storage_gb(F.col("name"), CONSOLE_PATTERNS["storage"]).alias("gb"), money.label_gb(label, 1000).alias("label_gb"),
        money.memory_gb(F.regexp_extract("name", r"(\d+ ?[A-Za-z]+)$", 1)).alias("memory"),
    )


def normalize_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normal"), urls.simple_url(F.col("url")).alias("simple"))


def stable_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.stable_item_id("PAGE", F.col("url")).alias("item_id"))


_URL = r"""
u AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+)://([^/?#]*)([^?#]*)(\?([^#]*))?', 1)) AS scheme, lower(regexp_extract(url, '^([a-zA-Z]+)://([^/?#]*)', 2)) AS host,
         regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages),
n AS (
  SELECT page_id, url, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END ||
         CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '')), '&') END AS normal FROM u)"""


# A word by itself, written so that both regular-expression dialects agree on accented letters.
_ALONE = r"(?:^|[^\p{{L}}\p{{N}}_])(?:{})(?:$|[^\p{{L}}\p{{N}}_])"


def is_relevant(spark, sf):
    rows = table(spark, sf, "documents")
    return rows.select("doc_id", filters.is_relevant(F.col("source"), F.col("text"), token=_ALONE.format("tion"), series=_ALONE.format("of|des"), context=_ALONE.format("the|und|les")).alias("relevant"))


def blocked_urls(spark, sf):
    """Pages whose address is not among the addresses of short pages."""
    rows = table(spark, sf, "pages")
    short = rows.where(F.length("html") < 3000).select(F.concat(F.upper("url"), F.lit("/")).alias("url"))
    return filters.drop_blocked_urls(rows, "url", short).select("page_id")


def is_console_name(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return rows.select("id", filters.is_console_name(F.col("name"), r"\b(red|blue)\b", r"\b(ring|rod|gear)\b").alias("console"))


# --- pages and raw records -------------------------------------------------------------------------

_LINK_CARDS = pages.CardSpec(pages.Pick("li"), {"href": pages.Pick("a", attr="href"), "label": pages.Pick("a")}, ("href",))


def page_cards(spark, sf):
    """List entries of the pages as cards: address and label."""
    return pages.extract_cards(table(spark, sf, "pages"), _LINK_CARDS)


def page_next(spark, sf):
    rows = table(spark, sf, "pages")
    return rows.select("page_id", pages.has_next_page(F.col("html"), r"(?i)<a href=\"/(la|the|die|der)\"").alias("has_next"))


def embedded_json(spark, sf):
    rows = table(spark, sf, "pages")
    return pages.extract_embedded_json(rows, pattern=r"(?s)<script>var t=\"</p>\";(.*?)</script>").select("page_id", F.col("json").alias("code"))


def listing_json(spark, sf):
    """Orders written as nested listing documents and read back."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    keyed = lambda k, v: F.struct(F.array(F.struct(k.alias("key"), v.alias("value"))).alias("values"))
    price = F.when(F.col("o_orderstatus") == "P", F.lit("0")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    doc = F.to_json(
        F.struct(
            F.concat(F.lit("Xbox "), "o_orderpriority").alias("subject"), F.lit(" body ").alias("body"), F.concat(F.lit("id:ad:x:list:"), F.col("o_orderkey").cast("string")).alias("urn"),
            day.alias("date"), F.struct(F.concat(F.lit("https://site/"), F.col("o_custkey").cast("string")).alias("default")).alias("urls"),
            F.create_map(F.lit("/price"), keyed(price, F.lit("shown")), F.lit("/item_condition"), keyed(F.when(F.col("o_orderstatus") == "O", "10").otherwise("30"), F.lit("c"))).alias("features"),
            F.struct(F.struct(F.lit(" Roma ").alias("value")).alias("town")).alias("geo"), F.struct((F.col("o_orderpriority") == "1-URGENT").alias("company")).alias("advertiser"),
            F.struct(F.when(F.col("o_orderstatus") == "F", "k").otherwise("s").alias("key")).alias("type"),
        )
    )
    flat = listings.flatten_listing_json(table(spark, sf, "orders").select(doc.alias("json")))
    return flat.select("sku", "name", "price", "price_display", "condition", "available", "url", "city", "region", "published_at", "seller_type")


def store_hits(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("boxId"), F.concat("p_name", F.when(F.col("p_size") > 25, ", Scontata").otherwise(", Non Imballata")).alias("boxName"), F.col("p_retailprice").alias("sellPrice"),
        F.when(F.col("p_size") > 45, 1).otherwise(0).cast("long").alias("ecomQuantity"), F.when(F.col("p_size") < 5, 2).cast("long").alias("collectionQuantity"), F.col("p_type").alias("categoryFriendlyName"),
    )
    return listings.flatten_hits(rows, "https://shop/").select("sku", "name", "price", "grade", "category", "available", "url")


def sold_rows(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("Console "), "p_name").alias("title"), F.concat(F.lit("EUR "), F.replace(F.format_string("%.2f", F.col("l_discount") * 100 + F.col("l_quantity") / 10), F.lit("."), F.lit(","))).alias("price_text"),
        F.lit(" 3 gen ").alias("sold_date"), F.concat(F.lit("https://x/itm/"), F.col("l_orderkey").cast("string")).alias("url"), F.col("p_brand").alias("query_label"),
    )
    out = listings.flatten_sold(rows, block=r"\b(anvil|rod)\b")
    return out.groupBy("sku", "query_label").agg(F.count("*").alias("rows"), F.max("price").alias("price"))


def variants(spark, sf):
    """Suppliers of a part as quality grades with a difference in price."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_discount").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    graded = lines.groupBy("l_partkey", "s_nationkey").agg(F.max("l_discount").alias("d"), F.min("s_acctbal").alias("b"))
    button = F.struct(
        F.concat(F.lit("a"), F.col("s_nationkey").cast("string")).alias("code"), F.lit("").alias("grade"),
        F.concat(F.lit("grade "), F.when(F.col("d") > 0.05, "+ ").otherwise("- "), F.replace(F.format_string("%.2f", F.col("d") * 100), F.lit("."), F.lit(",")), F.lit(" €")).alias("text"),
        (F.col("b") < 0).alias("disabled"),
    )
    # At most one grade per nation.
    per_part = graded.groupBy("l_partkey").agg(F.sort_array(F.collect_list(button)).alias("buttons"))
    parts = table(spark, sf, "part").join(per_part, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_name").alias("name"), F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("sku"), F.col("p_retailprice").alias("price"), F.lit("").alias("price_display"), F.lit(True).alias("available"),
        F.lit("").alias("grade"), "buttons",
    )
    out = listings.expand_variants(listings.variant_prices(parts, "price", "buttons").drop("buttons"))
    return out.select("sku", "name", "price", "available", "grade")


_VARIANTS = r"""
g AS (
  SELECT l_partkey, s_nationkey, max(l_discount) AS d, min(s_acctbal) AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT CASE WHEN g.l_partkey IS NULL THEN 'S' || p_partkey ELSE 'S' || p_partkey || '-A' || s_nationkey END AS sku,
       CASE WHEN g.l_partkey IS NULL THEN p_name ELSE p_name || ' [A' || s_nationkey || ']' END AS name,
       CASE WHEN g.l_partkey IS NULL THEN p_retailprice WHEN b < 0 THEN NULL ELSE round(p_retailprice + CASE WHEN d > 0.05 THEN 1 ELSE -1 END * round(d * 100, 2), 2) END AS price,
       CASE WHEN g.l_partkey IS NULL THEN true ELSE NOT b < 0 END AS available, CASE WHEN g.l_partkey IS NULL THEN '' ELSE 'A' || s_nationkey END AS grade
FROM part LEFT JOIN g ON p_partkey = g.l_partkey"""


def two_conditions(spark, sf):
    rows = table(spark, sf, "part")
    line = lambda label, stock, shown: F.struct(F.lit(label).alias("label"), stock.alias("in_stock"), shown.alias("price_text"))
    cards = rows.select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("B"), F.col("p_partkey").cast("string")).alias("base_sku"), F.when(F.col("p_type") == "PROMO", "Esaurito").otherwise("").alias("ribbon"),
        F.array(
            line(" Nuovo ", F.col("p_size") > 10, F.concat(F.col("p_retailprice").cast("string"), F.lit(" €"))), line("Usato", F.col("p_size") > 20, F.when(F.col("p_size") > 30, "12,50").otherwise("")),
            line("Altro", F.lit(True), F.lit("1")),
        ).alias("lines"),
    )
    return listings.two_condition_cards(cards).select("id", "sku", "condition", "price", "available")


def model_replies(spark, sf):
    """Event properties as model replies: fenced list, wrapped list, or loose text."""
    rows = table(spark, sf, "events")
    k = F.regexp_extract("props", r"(\d+)", 1)
    ident = F.col("event_id").cast("string")
    item = F.concat(F.lit('{"id": '), ident, F.lit(', "console_confidence": '), k, F.lit(', "family": "one"}'))
    reply = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n["), item, F.lit("]\n```")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"ads": ['), item, F.lit("]}")))
        .when(F.col("event_type") == "error", F.lit("sorry"))
        .otherwise(F.concat(F.lit("id: "), ident, F.lit(" then console_confidence: "), k, F.lit(" and so on")))
    )
    out = rows.select(F.explode(cascade.salvage_json(reply)).alias("s"))
    return out.select("s.id", "s.console_confidence", "s.family")


def select_regions(spark, sf):
    """Regions asked for by customers of the first nations, by name or slug."""
    names = {0: "Lombardia", 1: "emilia-romagna", 2: "Valle d'Aosta", 3: "Friuli-Venezia Giulia", 4: " "}
    out = None
    for k, v in names.items():
        out = F.when(F.col("c_nationkey") == k, v) if out is None else out.when(F.col("c_nationkey") == k, v)
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), out.otherwise("lazio").alias("token"))
    return joins.select_regions(rows, "token", "pos")


QUERIES = {
    "family_detect": (family_detect, f"WITH {_FAMILY_SQL} SELECT id, family FROM fam"),
    "classify_titles": (
        classify_titles,
        f"WITH {_MODEL_SQL} SELECT id, family AS console_family, sub AS sub_model, segment AS model_segment, edition AS edition_class, coalesce(cid, 'unknown') AS canonical_model, CASE segment WHEN 'unknown' THEN 0.35 WHEN 'premium' THEN 0.88 ELSE 0.9 END::DOUBLE AS classify_confidence, 'rules:parts' AS classify_method FROM full_class",
    ),
    "classify_with_hint": (classify_with_hint, f"WITH {_hint_sql()}"),
    "standardize_titles": (standardize_titles, f"WITH {_STANDARD_SQL}"),
    "search_attributes": (
        search_attributes,
        f"WITH {_FAMILY_SQL} SELECT id, CASE WHEN {_pos('plate')} > 0 THEN 'Plate' WHEN {_pos('gear')} > 0 THEN 'Gear' ELSE 'Standard' END AS edition_name, CASE WHEN {_pos('hot')} > 0 THEN 'Hot' WHEN {_pos('cold')} > 0 THEN 'Cold' WHEN {_pos('old')} > 0 THEN 'Old' ELSE '' END AS color, CAST(NULL AS INT) AS has_kinect FROM parts",
    ),
    "rules_and_anchor_pass": (
        rules_and_anchor_pass, f"WITH {_RULED} SELECT family AS console_family, canonical AS canonical_model, method AS classify_method, count(*) AS rows, max(confidence) AS confidence FROM passed GROUP BY 1, 2, 3"
    ),
    "rules_open_rows": (
        rules_open_rows,
        f"WITH {_RULED} SELECT id, family AS console_family, segment AS model_segment, confidence AS classify_confidence FROM passed WHERE family = 'other' OR segment = 'unknown' OR confidence < 0.6",
    ),
    "rule_results": (
        rule_results,
        "WITH " + _RULED + " SELECT p.p_partkey AS id, " + ", ".join(
            f"CASE WHEN p_size > 10 THEN {new} ELSE {old} END AS {name}" for new, old, name in (
                ("family", "'before'", "console_family"), ("segment", "'before'", "model_segment"), ("edition", "'before'", "edition_class"), ("canonical", "'before'", "canonical_model"),
                ("method", "'before'", "classify_method"), ("'rules:v3'", "'before'", "classify_version"), ("confidence", "0.1::DOUBLE", "classify_confidence"),
            )
        ) + " FROM part p JOIN passed ON passed.id = p.p_partkey",
    ),
    "console_titles": (console_titles, None),
    "text_hash": (text_hash, f"SELECT doc_id, sha1(lower(trim(source)) || chr(10) || lower({_SQUEEZED})) AS text_hash FROM documents"),
    "tokens": (tokens, f"WITH {_TOKENS} SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS digest FROM tok"),
    "jaccard": (
        jaccard,
        f"WITH {_TOKENS}, f AS (SELECT source, arg_min(t, doc_id) AS u FROM tok GROUP BY 1) SELECT doc_id, CASE WHEN len(t) = 0 OR len(u) = 0 THEN 0 ELSE len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u)))::DOUBLE END AS score FROM tok JOIN f USING (source)",
    ),
    "sanitize": (
        sanitize,
        r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '[<>"''`]', ' ', 'g'), '[\x00-\x1F\x7F]', ' ', 'g'), '\s{2,}', ' ', 'g'))) AS digest, CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE '' END AS url FROM pages""",
    ),
    "sanitize_records": (sanitize_records, _RECORDS),
    "input_hash": (
        input_hash,
        f"""SELECT doc_id, sha256('{{"body":' || CAST(to_json(lower({_SQUEEZED})) AS VARCHAR) || ',"price":' || coalesce(CAST(to_json(CAST(n_chars / 4.0 AS DOUBLE)) AS VARCHAR), 'null')
            || ',"prompt_version":"p1","taxonomy_version":"t1","title":' || CAST(to_json(lower(coalesce(trim(regexp_replace(source, '\\s+', ' ', 'g')), ''))) AS VARCHAR) || '}}') AS input_hash FROM documents""",
    ),
    "redact": (
        redact,
        r"""WITH r AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b\d{6,}:[A-Za-z0-9_-]{20,}\b', '***', 'g'), 'sk-[A-Za-z0-9-]{16,}', '***', 'g'), '(?i)(token|api[_-]?key|password)\s*[=:]\s*\S+', '***', 'g'), '(?i)bearer\s+[A-Za-z0-9._\-]+', '***', 'g') AS clean FROM documents) SELECT doc_id, text <> clean AS changed, length(clean) AS length FROM r""",
    ),
    "shorten": (shorten, f"WITH s AS (SELECT doc_id, {_SQUEEZED} AS v FROM documents) SELECT doc_id, CASE WHEN length(v) <= 120 THEN v ELSE substr(v, 1, 119) || '…' END AS short FROM s"),
    "slugs": (
        slugs,
        f"WITH l AS (SELECT doc_id, text AS line FROM documents), s AS (SELECT doc_id, regexp_replace(regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s, regexp_replace(regexp_replace(translate(lower(trim(line)), '{_ACCENTS[0]}', '{_ACCENTS[1]}'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS token FROM l) SELECT doc_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug, token FROM s",
    ),
    "title_case": (
        title_case,
        "SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '-B' || substr(lower(p_brand), 2) AS title FROM part",
    ),
    "clean_price": (clean_price, "SELECT l_extendedprice AS plain, l_extendedprice AS euro, l_extendedprice AS both FROM lineitem"),
    "format_price": (format_price, "SELECT p_partkey AS id, replace(printf('%.2f', p_retailprice), '.', ',') || ' €' AS shown FROM part"),
    "storage_parse": (
        storage_parse,
        "SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN p_size || ' TB' WHEN p_size > 20 THEN p_size || ' GB' END AS label, CAST(CASE WHEN p_size > 40 THEN p_size * 1024 WHEN p_size > 20 THEN p_size END AS BIGINT) AS gb, CASE WHEN p_size > 40 THEN p_size * 1000.0 WHEN p_size > 20 THEN p_size ELSE 0 END::DOUBLE AS label_gb, CASE WHEN p_size > 40 THEN p_size * 1024.0 WHEN p_size > 20 THEN p_size ELSE round(p_size / 1024.0::DOUBLE, 4) END::DOUBLE AS memory FROM part",
    ),
    "normalize_url": (normalize_url, f"WITH {_URL} SELECT page_id, normal, rtrim(lower(trim(url)), '/') AS simple FROM n"),
    "stable_id": (stable_id, f"WITH {_URL} SELECT page_id, 'PAGE-' || upper(substr(sha1(normal), 1, 16)) AS item_id FROM n"),
    "is_relevant": (
        is_relevant,
        "WITH d AS (SELECT doc_id, source || chr(10) || text AS t FROM documents) SELECT doc_id, "
        + " OR ".join([f"regexp_matches(t, '(?i){_ALONE.format('tion')}')", f"(regexp_matches(t, '(?i){_ALONE.format('of|des')}') AND regexp_matches(t, '(?i){_ALONE.format('the|und|les')}'))"])
        + " AS relevant FROM d",
    ),
    "blocked_urls": (blocked_urls, "SELECT page_id FROM pages WHERE rtrim(lower(url), '/') NOT IN (SELECT rtrim(lower(url), '/') FROM pages WHERE length(html) < 3000)"),
    "is_console_name": (is_console_name, "SELECT p_partkey AS id, regexp_matches(p_name, '\\b(red|blue)\\b') AND regexp_matches(p_name, '\\b(ring|rod|gear)\\b') AS console FROM part"),
    "page_cards": (
        page_cards,
        "WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 1) AS h, regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 2) AS n FROM pages) SELECT page_id, i AS card_no, h[i + 1] AS href, n[i + 1] AS label FROM l, unnest(range(len(h))) AS u(i)",
    ),
    "page_next": (page_next, "SELECT page_id, regexp_matches(html, '(?i)<a href=\"/(la|the|die|der)\"') AS has_next FROM pages"),
    "embedded_json": (embedded_json, "SELECT page_id, nullif(regexp_extract(html, '<script>var t=\"</p>\";(.*?)</script>', 1, 's'), '') AS code FROM pages"),
    "listing_json": (
        listing_json,
        "SELECT 'SUBITO-' || o_orderkey AS sku, 'Xbox ' || o_orderpriority AS name, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price, CASE WHEN o_orderstatus = 'P' THEN 'Trattabile' ELSE 'shown' END AS price_display, CASE WHEN o_orderstatus = 'O' THEN 'Nuovo' ELSE 'Usato' END AS condition, o_orderstatus <> 'F' AS available, 'https://site/' || o_custkey AS url, 'Roma' AS city, '' AS region, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS published_at, CASE WHEN o_orderpriority = '1-URGENT' THEN 'professionale' ELSE 'privato' END AS seller_type FROM orders",
    ),
    "store_hits": (
        store_hits,
        "SELECT 'CEX-' || p_partkey AS sku, p_name || CASE WHEN p_size > 25 THEN ', Scontata' ELSE ', Non Imballata' END AS name, p_retailprice AS price, CASE WHEN p_size > 25 THEN 'Scontata' ELSE 'Non Imballata' END AS grade, p_type AS category, p_size > 45 OR p_size < 5 AS available, 'https://shop/' || p_partkey AS url FROM part",
    ),
    "sold_rows": (
        sold_rows,
        "WITH r AS (SELECT 'EBAY-' || l_orderkey AS sku, p_brand AS query_label, round(l_discount * 100 + l_quantity / 10, 2) AS price FROM lineitem JOIN part ON l_partkey = p_partkey WHERE NOT regexp_matches(p_name, '\\b(anvil|rod)\\b')) SELECT sku, query_label, count(*) AS rows, max(price) AS price FROM r WHERE price >= 8 GROUP BY 1, 2",
    ),
    "variants": (variants, f"WITH {_VARIANTS}"),
    "two_conditions": (
        two_conditions,
        "SELECT p_partkey AS id, 'B' || p_partkey || '_N' AS sku, 'Nuovo' AS condition, p_retailprice AS price, p_size > 10 AND p_type <> 'PROMO' AS available FROM part UNION ALL SELECT p_partkey, 'B' || p_partkey || '_U', 'Usato', CASE WHEN p_size > 30 THEN 12.5 END, p_size > 30 AND p_type <> 'PROMO' FROM part",
    ),
    "model_replies": (
        model_replies,
        "SELECT event_id AS id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS console_confidence, CASE WHEN event_type IN ('click', 'view') THEN 'one' END AS family FROM events WHERE event_type <> 'error'",
    ),
    "select_regions": (
        select_regions,
        "WITH r(k, label, slug) AS (VALUES (0, 'Lombardia', 'lombardia'), (1, 'Emilia-Romagna', 'emilia-romagna'), (2, 'Valle d''Aosta', 'valle-d-aosta'), (3, 'Friuli-Venezia Giulia', 'friuli-venezia-giulia'), (5, 'Lazio', 'lazio')) SELECT label, slug, min(c_custkey) AS first_position FROM customer JOIN r ON k = CASE WHEN c_nationkey > 4 THEN 5 ELSE c_nationkey END GROUP BY 1, 2",
    ),
}
