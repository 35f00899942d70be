"""Quality rules learned as an ordered decision list, in DataFrame operations alone.

Statistics of each text are columns built from array and string functions. The list is learned
by sequential covering: a rule grows, one threshold at a time, towards the conjunction with the
best information gain on labelled bad texts, is pruned on labelled texts kept aside, and the
texts it covers are taken out before the next rule grows. Every step is one aggregate over
binned statistics, whose result has as many rows as there are features and bins. The learned
list is a ``CASE WHEN`` expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from marketlens.session import settle

_SPACE = r"[\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "word_length", "symbols", "marks", "capitals", "digits", "repeated_lines", "repeated_words", "distinct_words")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _windows(words: Column, n: Column) -> Column:
    """Hashes of all windows of eight words, doubled from hashes of one, two and four."""
    def wider(hashes: Column, step: int) -> Column:
        return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))

    ones = F.transform(words, lambda w: F.xxhash64(w))
    eights = _let(ones, lambda a: _let(wider(a, 1), lambda b: _let(wider(b, 2), lambda c: wider(c, 4))))
    return F.when(n >= 8, F.slice(eights, F.lit(1), n - 7)).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash comes up twice or more."""
    def cover(ranked: Column) -> Column:
        def repeated(s: Column, i: Column) -> Column:
            same = F.coalesce(s["h"] == F.get(ranked, i - 1)["h"], F.lit(False)) | F.coalesce(s["h"] == F.get(ranked, i + 1)["h"], F.lit(False))
            return F.when(same, s["p"])

        places = F.sort_array(F.filter(F.transform(ranked, repeated), lambda p: p.isNotNull()))
        return _let(places, lambda a: F.aggregate(
            F.transform(a, lambda p, i: F.least(F.lit(8), F.coalesce(F.get(a, i + 1) - p, F.lit(8)))), F.lit(0).cast("long"), lambda s, x: s + x
        ))

    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(ranked, cover))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts and the features of each whole text, without the text.

    Words are split at blanks, tabs and line breaks; a null text has none. Equal windows of
    eight words are told by a 64-bit hash. Columns of the added names are replaced.
    """
    def without(pattern: str) -> Column:
        return F.length(F.col("_t")) - F.length(F.regexp_replace("_t", pattern, ""))

    read = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).drop(text)
    split = read.withColumns({
        "_words": F.filter(F.split("_t", _SPACE), lambda w: w != ""),
        "_lines": F.filter(F.split("_t", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": without(r"[#*$%&|<>]+").cast("long"), "_marks": without("[!?]+"), "_capitals": without(r"\p{Lu}+"), "_digits": without("[0-9]+"),
    })
    counted = split.withColumn("n_words", F.size("_words").cast("long")).withColumn("_windows", _windows(F.col("_words"), F.size("_words")))
    base = counted.withColumns({
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "_n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _covered(F.col("_windows")),
        "_n_distinct": F.size(F.array_distinct("_words")).cast("long"),
    }).drop("_t", "_words", "_lines", "_windows")
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    per_char = F.greatest(F.col("word_chars"), F.lit(1))
    features = {
        "words": F.col("n_words").cast("double"), "word_length": F.col("word_chars") / per_word, "symbols": F.col("n_symbols") / per_word,
        "marks": F.col("_marks") / per_word, "capitals": F.col("_capitals") / per_char, "digits": F.col("_digits") / per_char,
        "repeated_lines": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)), "repeated_words": F.col("n_repeat_words") / per_word,
        "distinct_words": F.col("_n_distinct") / per_word,
    }
    return base.withColumn("features", F.struct(*[c.alias(n) for n, c in features.items()])).drop("_marks", "_capitals", "_digits", "_n_lines", "_n_distinct")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature > threshold`` or ``feature <= threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col("features")[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as a conditional expression: the first rule that holds rejects, else the text is kept."""
    if not rules:
        return F.lit(True)
    case = F.when(holds(rules[0]), False)
    for rule in rules[1:]:
        case = case.when(holds(rule), False)
    return case.otherwise(True)


def _bin(cuts: list[float], value: Column) -> Column:
    """How many cuts lie below a value."""
    return F.size(F.filter(F.lit(cuts), lambda t: t < value))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(
    rows: DataFrame, bad: str = "bad", max_rules: int = 8, max_conditions: int = 4, bins: int = 64, precision: float = 0.9, least: int = 5,
) -> list[Rule]:
    """An ordered list of rejecting rules from rows with ``features`` and a boolean ``bad``.

    A third of the rows, by a hash of their features, is kept aside to prune. A rule is taken if
    at least ``precision`` of what it covers there is bad and it covers ``least`` bad rows
    among those it grew on; learning ends with the first that is not. No bad or no good rows
    give no rules; rows with a null ``bad`` are left out.
    """
    known = settle(rows.where(F.col(bad).isNotNull()).select("features", F.col(bad).cast("int").alias("bad")))
    cuts = known.agg(*[
        F.array_sort(F.array_distinct(F.percentile_approx(f"features.{f}", [i / bins for i in range(bins)], 10_000))).alias(f) for f in FEATURES
    ]).first()
    if cuts is None or cuts[0] is None:
        return []
    binned = settle(known.select(
        "bad", "features", F.pmod(F.xxhash64("features", F.lit(3)), F.lit(3)).alias("part"),
        *[_bin(cuts[f], F.col("features")[f]).alias(f"bin_{f}") for f in FEATURES],
    ))
    rules: list[Rule] = []
    left = binned
    while len(rules) < max_rules:
        rule, covers = _grow(left.where("part <> 0"), cuts, max_conditions)
        if not rule or covers < least:
            break
        rule = _prune(left.where("part = 0"), rule, precision)
        if not rule:
            break
        rules.append(rule)
        left = left.where(~holds(rule))
    return rules


def _grow(rows: DataFrame, cuts, most: int) -> tuple[Rule, int]:
    rule: Rule = ()
    p0 = n0 = 0
    for _ in range(most):
        cells = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in FEATURES])
        seen = rows.where(holds(rule)).select("bad", F.explode(cells).alias("_c")).groupBy("_c.f", "_c.b").agg(
            F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")
        ).collect()  # at most features times bins rows
        by: dict[str, dict[int, tuple[int, int]]] = {}
        for r in seen:
            by.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
        if not by:
            break
        first = next(iter(by.values()))
        p0, n0 = (sum(v[k] for v in first.values()) for k in (0, 1))
        if not p0 or not n0:
            break
        best, choice = 1e-9, None
        for f in FEATURES:
            p = n = 0
            for b in range(len(cuts[f])):
                # Bins up to b hold the values up to cut b.
                x = by[f].get(b, (0, 0))
                p, n = p + x[0], n + x[1]
                for above, (q, m) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    gain = _gain(q, m, p0, n0)
                    if gain > best * (1 + 1e-12):
                        best, choice = gain, (Condition(f, above, cuts[f][b]), q, m)
        if choice is None:
            break
        rule, p0, n0 = (*rule, choice[0]), choice[1], choice[2]
        if not n0:
            break
    return rule, p0


def _prune(rows: DataFrame, rule: Rule, precision: float) -> Rule:
    """The beginning of the rule with the best (bad - good) / all on rows kept aside, if precise."""
    sums = []
    for k in range(1, len(rule) + 1):
        inside = holds(rule[:k]).cast("int")
        sums += [F.sum(inside * F.col("bad")).alias(f"p{k}"), F.sum(inside * (1 - F.col("bad"))).alias(f"n{k}")]
    seen = rows.agg(*sums).first()
    best, keep = None, ()
    for k in range(1, len(rule) + 1):
        p, n = seen[f"p{k}"] or 0, seen[f"n{k}"] or 0
        if p and p >= precision * (p + n):
            worth = (p - n) / (p + n), p
            if best is None or worth > best:
                best, keep = worth, rule[:k]
    return keep


def labelled(stats: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """Statistics of labelled documents with ``bad`` (the label is 0)."""
    known = labels.where(F.col(label).isNotNull()).select(F.col(id_col).alias("_label_id"), (F.col(label) == 0).alias("bad"))
    return stats.join(known, F.col(id_col) == F.col("_label_id")).drop("_label_id")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[Rule]]:
    """Statistics, ``base_failed`` and ``kept`` per document, and the learned list.

    ``kept`` is false where the base rules fail, else the list's verdict. Null and empty texts
    fail the base rules; repeated rows are judged alike; rows without an id are judged, but not
    learned from. An empty table gives no rows; other columns are not read.
    """
    stats = settle(with_statistics(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text")), "_text"))
    rules = learn(labelled(stats, labels, id_col=id_col))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules
