"""PII removal with information-theoretic sanitisation, in DataFrame operations alone.

Base spans (e-mail, IP, card and phone numbers) are found by patterns. Their values are the
protected entities. A term of a document with an entity discloses it if seeing the term tells nearly as
much as the entity's own information: with pointwise mutual information PMI(c, t) =
log2(p(c, t) / (p(c) p(t))) and IC(c) = -log2 p(c), a term with PMI >= ``generalise`` * IC is
replaced by its class and one with PMI >= ``remove`` * IC is removed. Probabilities are counted
over whole documents, in distinct texts (copies count once). A disclosing term is marked wherever it stands, also in documents without a
base span: seeing it there tells as much.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketlens.session import settle

KINDS = ("email", "ip", "card", "phone")
# Possessive forms of the patterns: they match the same text, in time linear in its length. A
# failing run of characters fails from each of its places, so it is tried from the first alone.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MAYBE = {
    "email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": lambda t: F.contains(t, F.lit("+")),
}
# A word between blanks from its first letter or digit to its last. ASCII stands first, where a table decides.
_WORD = r"[a-zA-Z0-9\p{L}\p{N}](?:[^\x20\n\t\r]*[a-zA-Z0-9\p{L}\p{N}])?"
_PART = 128


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def before(lengths: Column) -> Column:
    """Sum of all earlier elements, per element; parts keep the work near linear."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def spread(parts: Column) -> Column:
        def sums(totals: Column) -> Column:
            return F.flatten(F.transform(parts, lambda part, k: F.transform(
                part, lambda _, i: total(F.slice(totals, F.lit(1), k)) + total(F.slice(part, F.lit(1), i))
            )))

        return _let(F.transform(parts, total), sums)

    starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _PART).cast("int"))).otherwise(F.array().cast("array<int>"))
    return _let(F.transform(starts, lambda k: F.slice(lengths, k * _PART + 1, F.lit(_PART))), spread)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """Spans of one kind; their places follow from what the pattern leaves between its matches."""
    def build(found: Column) -> Column:
        def place(gaps: Column) -> Column:
            widths = F.zip_with(gaps, found, lambda g, m: F.struct(
                F.length(g).cast("long").alias("gap"), F.coalesce(F.length(m), F.lit(0)).cast("long").alias("own")
            ))
            def rows(w: Column) -> Column:
                def row(start: Column, i: Column) -> Column:
                    at = start + w[i]["gap"]
                    return F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + w[i]["own"]).alias("end"), found[i].alias("value"))

                return F.transform(before(F.transform(F.slice(w, F.lit(1), F.size(found)), lambda x: x["gap"] + x["own"])), row)

            return _let(widths, rows)

        return _let(F.split(text, PATTERNS[kind], -1), place)

    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    spans = F.when(_MAYBE[kind](text), _let(matches, lambda m: F.when(F.size(m) > 0, build(m)).otherwise(none))).otherwise(none)
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def with_base_spans(docs: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """Adds the base spans in the order of kinds, then start; code points, end exclusive."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(out, F.concat(*[_spans(k, value) for k in KINDS]))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of spans joined with commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


# ---- disclosing terms -------------------------------------------------------------------


def _entity(kind: Column, value: Column) -> Column:
    return F.concat_ws(":", kind, F.when(kind == "email", F.lower(value)).when(kind == "ip", value).otherwise(_digits(value)))


def _blanked(text: Column, base: Column) -> Column:
    """The text with blanks of the same length in place of its base spans."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, b: Column) -> Column:
        gap = F.substring(text, (s["at"] + 1).cast("int"), F.greatest(b["start"] - s["at"], F.lit(0)).cast("int"))
        own = F.repeat(F.lit(" "), F.greatest(b["end"] - F.greatest(b["start"], s["at"]), F.lit(0)).cast("int"))
        return F.struct(F.concat(s["parts"], F.array(gap, own)).alias("parts"), F.greatest(s["at"], b["end"]).alias("at"))

    places = F.sort_array(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
    blanked = F.aggregate(places, start, step, lambda s: F.concat(
        F.array_join(s["parts"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))
    ))
    return F.when(F.size(base) == 0, text).otherwise(blanked)


def _core(word: Column) -> Column:
    return F.regexp_extract(word, _WORD, 0)


def _terms(blanked: Column) -> Column:
    """Distinct terms: words between blanks without marks at their edges, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(blanked, F.lit(_WORD), F.lit(0)), F.lower))


def _places(text: Column, wanted: Column) -> Column:
    """(start, end, action, value) of each word of ``text`` whose term is in ``wanted``, an array of (term, action)."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def of_words(words: Column) -> Column:
        def placed(lengths: Column) -> Column:
            def at(totals: Column) -> Column:
                def row(hit: Column) -> Column:
                    i, word = hit["i"], hit["word"]
                    part = F.floor(i / _PART).cast("int")
                    start = total(F.slice(totals, F.lit(1), part)) + total(F.slice(lengths, part * _PART + 1, i - part * _PART))
                    skip = F.length(word) - F.length(F.regexp_replace(word, r"^[^\p{L}\p{N}]+", ""))
                    core = _core(word)
                    return F.struct(
                        (start + skip).alias("start"), (start + skip + F.length(core)).alias("end"), hit["action"].alias("action"), core.alias("value")
                    )

                def hits(terms: Column) -> Column:
                    return F.filter(F.transform(words, lambda w, i: F.struct(
                        i.alias("i"), w.alias("word"), F.array_position(terms, F.lower(_core(w))).cast("int").alias("of")
                    )), lambda h: h["of"] > 0)

                found = F.transform(_let(wanted["term"], hits), lambda h: F.struct(h["i"], h["word"], F.get(wanted["action"], h["of"] - 1).alias("action")))
                return F.transform(found, row)

            starts = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _PART).cast("int"))
            return _let(F.transform(starts, lambda k: total(F.slice(lengths, k * _PART + 1, F.lit(_PART)))), at)

        return _let(F.transform(words, lambda w: (F.length(w) + 1).cast("long")), placed)

    # Bound once: each step reads the words, and a step inside of a lambda would split the text again.
    return _let(F.split(text, r"[\x20\n\t\r]", -1), of_words)


_SLOTS = 1 << 16


def _maybe_in(df: DataFrame, key: str):
    """Test of a hash: false only if it is no value of ``key``. Spares rows the shuffle before a join that decides."""
    slot = lambda h: F.pmod(h, F.lit(_SLOTS * 64))
    bit = lambda h: slot(h).bitwiseAND(F.lit(63)).cast("int")
    place = lambda h: F.call_function("shiftright", slot(h), F.lit(6)).cast("int")
    set_ = df.groupBy(place(F.col(key)).alias("_place")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col(key)))).alias("_bits"))
    every = df.sparkSession.range(_SLOTS).join(set_, F.col("id") == F.col("_place"), "left")
    rows = F.sort_array(F.collect_list(F.struct("id", F.coalesce("_bits", F.lit(0).cast("long")).alias("bits"))))
    bits = every.agg(F.transform(rows, lambda r: r["bits"]).alias("b")).scalar()
    return lambda h: F.call_function("shiftright", F.get(bits, place(h)), bit(h)).bitwiseAND(F.lit(1).cast("long")) == 1


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text, text_hash): each text once. Only rows that may have copies are shuffled."""
    plain = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).withColumn("text_hash", F.xxhash64("text"))
    copied = settle(plain.groupBy("text_hash").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("text_hash"))
    maybe = _maybe_in(copied, "text_hash")(F.col("text_hash"))
    return plain.where(~maybe).unionByName(plain.where(maybe).distinct())


def disclosing_terms(
    texts: DataFrame, generalise: float = 0.8, remove: float = 0.95, least: int = 2,
) -> DataFrame:
    """(entity, term, share, action): terms that disclose an entity, by ``share`` = PMI / IC.

    ``texts`` are the distinct texts. A pair must be seen in at least ``least`` of them: in one
    alone, every word not met elsewhere would disclose whatever stands beside it.
    """
    total = F.greatest(texts.select(F.count("*").alias("n")).scalar(), F.lit(2)).cast("double")
    counted = with_base_spans(texts).select(F.explode(_terms(_blanked(F.col("text"), F.col("base")))).alias("term"))
    frequency = counted.groupBy(F.col("term").alias("_term")).agg(F.count("*").alias("n_term"))
    spanned = with_base_spans(texts).where(F.size("base") > 0)
    tied = settle(spanned.select(
        F.monotonically_increasing_id().alias("row"), _terms(_blanked(F.col("text"), F.col("base"))).alias("terms"),
        F.array_distinct(F.transform("base", lambda s: _entity(s["kind"], s["value"]))).alias("entities"),
    ))
    # n_both is at most n_entity, so a term above the frequency ``most`` cannot reach the share.
    most = F.pow(total, F.lit(1 - generalise)) * F.pow("n_entity", F.lit(generalise)) * (1 + 1e-9)
    entities = settle(tied.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")).where(
        (F.col("n_entity") >= least) & (F.col("n_entity") < total)
    ).withColumn("most", most))
    top = F.coalesce(entities.select(F.max("most").alias("n")).scalar(), F.lit(0.0))
    wanted = tied.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_tied")).where(F.col("n_tied") >= least)
    missing = F.raise_error(F.concat(F.lit("no document frequency of term "), F.col("term"))).cast("long")
    n_term = F.when(F.col("n_term") >= F.col("n_tied"), F.col("n_term")).otherwise(missing)
    known = settle(wanted.join(frequency, F.col("term") == F.col("_term"), "left").select("term", n_term.alias("n_term")).where(F.col("n_term") <= top))
    per_row = tied.select("row", F.explode("entities").alias("entity")).join(entities, "entity").groupBy("row").agg(
        F.collect_list(F.struct("entity", "n_entity", "most")).alias("of")
    )
    words = tied.select("row", F.explode("terms").alias("term")).where(_maybe_in(known.select(F.xxhash64("term").alias("h")), "h")(F.xxhash64("term")))
    pairs = words.join(known, "term").join(per_row, "row").select(
        "term", "n_term", F.explode(F.filter("of", lambda e: F.col("n_term") <= e["most"])).alias("e")
    ).groupBy(F.col("e.entity").alias("entity"), "term").agg(
        F.count("*").alias("n_both"), F.first("e.n_entity").alias("n_entity"), F.first("n_term").alias("n_term")
    ).where(F.col("n_both") >= least)
    own = F.log2(total / F.col("n_entity"))
    share = F.log2(F.col("n_both") * total / (F.col("n_entity") * F.col("n_term"))) / own
    return pairs.withColumn("share", share).where(F.col("share") >= generalise).select(
        "entity", "term", "share", F.when(F.col("share") >= remove, "removed").otherwise("generalised").alias("action")
    )


def _with_terms(docs: DataFrame, text: str, thresholds: dict) -> DataFrame:
    """Adds ``base`` and ``terms``: every disclosing term of any entity, wherever it stands outside of base spans."""
    texts = distinct_texts(docs, text)
    found = disclosing_terms(texts, **thresholds).groupBy("term").agg(F.min(F.when(F.col("action") == "removed", 0).otherwise(1)).alias("o"))
    found = settle(found.select("term", F.when(F.col("o") == 0, "removed").otherwise("generalised").alias("action")))
    words = with_base_spans(texts).select("text_hash", F.explode(_terms(_blanked(F.col("text"), F.col("base")))).alias("term"))
    likely = words.where(_maybe_in(found.select(F.xxhash64("term").alias("h")), "h")(F.xxhash64("term")))
    # At most as many as a text has terms. Texts that share a hash share the list, of which each uses its own terms.
    per_text = likely.join(found, "term").groupBy("text_hash").agg(F.collect_set(F.struct("term", "action")).alias("_wanted"))
    hashed = docs.withColumn("_hash", F.xxhash64(text))
    joined = with_base_spans(hashed.join(per_text, F.col("_hash") == F.col("text_hash"), "left"), text)
    none = F.array().cast("array<struct<start:bigint,end:bigint,action:string,value:string>>")
    terms = F.when(F.col("_wanted").isNull(), none).otherwise(_places(_blanked(F.col(text), F.col("base")), F.col("_wanted")))
    return joined.withColumn("terms", terms).drop("_wanted", "_hash", "text_hash")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """One row per document: id, ``base`` spans and ``terms`` (disclosing terms with action).

    Null and empty texts have no spans; repeated rows are treated alike; an empty table gives no
    rows; other columns are not read. Base spans of different kinds may overlap; terms never
    touch a base span.
    """
    plain = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))
    return _with_terms(plain, "_text", thresholds).select(id_col, "base", "terms")


def _class_of(value: Column) -> Column:
    return F.when(value.rlike(r"\p{N}"), "<CODE>").when(value.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<WORD>")


def clean(docs: DataFrame, text_col: str = "text", **thresholds) -> DataFrame:
    """``docs`` with base spans replaced by their kind and disclosing terms by their class or nothing.

    Of overlapping base spans the one that begins first (of equals the longest) is replaced
    together with what overlaps it. Null texts stay null; all columns and rows stay.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("all"), F.col(f"`{text_col}`").alias("_text"))
    termed = _with_terms(packed, "_text", thresholds)
    marks = F.sort_array(F.concat(
        F.transform("base", lambda b: F.struct(b["start"].alias("start"), (-b["end"]).alias("back"), F.concat(F.lit("<"), F.upper(b["kind"]), F.lit(">")).alias("put"))),
        F.transform("terms", lambda t: F.struct(t["start"].alias("start"), (-t["end"]).alias("back"), F.when(t["action"] == "removed", "").otherwise(_class_of(t["value"])).alias("put"))),
    ))
    # One pass over the marks: text up to the mark, what is put in its place, and how far it reached.
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, m: Column) -> Column:
        own = F.array(F.substring(F.col("_text"), (s["at"] + 1).cast("int"), (m["start"] - s["at"]).cast("int")), m["put"])
        return F.struct(
            F.when(m["start"] >= s["at"], F.concat(s["parts"], own)).otherwise(s["parts"]).alias("parts"), F.greatest(s["at"], -m["back"]).alias("at")
        )

    done = termed.withColumn("_done", F.aggregate(marks, start, step))
    rest = F.substring(F.col("_text"), (F.col("_done.at") + 1).cast("int"), F.length("_text"))
    changed = F.when(F.size(marks) == 0, F.col("_text")).otherwise(F.concat(F.array_join("_done.parts", ""), rest))
    return done.withColumn("_new", changed).select(*[F.col("_new").alias(c) if c == text_col else F.col(f"all.`{c}`").alias(c) for c in names])
