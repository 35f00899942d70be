"""What a title says: family, model, edition, colours, features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from marketlens.catalog import CONSOLE_RULES, TitleRules
from marketlens.functions.scores import lookup
from marketlens.functions.text import first_pos, matches, plain_words


def _hits(title: Column, rules) -> Column:
    """Position, tie-break and value of every rule that matches; each pattern is tried once."""
    tried = [F.struct(first_pos(title, p).alias("pos"), F.lit(tie).alias("tie"), F.lit(v).alias("value")) for v, p, tie in rules]
    return F.filter(F.array(*tried), lambda h: h["pos"] > 0)


def _earliest(title: Column, rules, value) -> Column:
    """Value of the rule that matches first; equal positions go to the smaller tie-break."""
    return F.array_min(_hits(title, rules))[value] if rules else F.lit(None).cast("string")


def _first_rule(title: Column, rules, default: str) -> Column:
    chain = reduce(
        lambda acc, r: F.when(matches(title, r[1]), F.lit(r[0])) if acc is None else acc.when(matches(title, r[1]), F.lit(r[0])),
        rules,
        None,
    )
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def detect_family(title: Column, rules: TitleRules = CONSOLE_RULES) -> Column:
    text = F.trim(F.coalesce(title, F.lit("")))
    found = _earliest(text, [(k, p, -s) for k, p, s in rules.families], "value")
    bare = F.lit(None).cast("string")
    if rules.bare_family:
        bare = F.when(matches(text, rules.bare_family[0]), F.lit(rules.bare_family[1]))
    return F.coalesce(found, bare, F.lit("other"))


def canonical_family(family: Column, rules: TitleRules = CONSOLE_RULES) -> Column:
    key = F.lower(F.trim(F.coalesce(family, F.lit(""))))
    mapped = lookup({a: target for a, (target, _) in rules.aliases.items()}, key) if rules.aliases else F.lit(None).cast("string")
    return F.when(key == "", F.lit("other")).otherwise(F.coalesce(mapped, key))


def hinted_model(hint: Column, rules: TitleRules = CONSOLE_RULES) -> Column:
    known = {a: m for a, (_, m) in rules.aliases.items() if m}
    if not known:
        return F.lit(None).cast("string")
    return lookup(known, F.lower(F.trim(F.coalesce(hint, F.lit("")))))


def model_of(title: Column, family: Column, hint: Column | None = None, rules: TitleRules = CONSOLE_RULES) -> Column:
    hinted = F.lit(None).cast("string") if hint is None else hinted_model(hint, rules)
    out = None
    for key, rule in rules.models.items():
        if rule.earliest:
            hit = _earliest(title, [(label, p, label) for label, p in rule.rules], "value")
            value = F.coalesce(hit, hinted, F.lit(rule.default))
        else:
            value = _first_rule(title, rule.rules, rule.default)
        out = F.when(family == key, value) if out is None else out.when(family == key, value)
    fallback = F.coalesce(hinted, F.lit("Unknown"))
    return fallback if out is None else out.otherwise(fallback)


def sub_model(model: Column, rules: TitleRules = CONSOLE_RULES) -> Column:
    raw = F.coalesce(model, F.lit(""))
    known = lookup(rules.sub_models, F.lower(F.trim(raw))) if rules.sub_models else F.lit(None).cast("string")
    return F.coalesce(known, F.when(raw != "", raw), F.lit("Unknown"))


def base_family_label(family: Column, rules: TitleRules = CONSOLE_RULES) -> Column:
    labels = {"series": "Series", "one": "One", "360": "360", "original": "Original"}
    return F.coalesce(lookup(labels, canonical_family(family, rules)), F.lit("other"))


def edition_class(title: Column, rules: TitleRules = CONSOLE_RULES) -> Column:
    p = rules.patterns
    return _first_rule(title, [("bundle", p["bundle"]), ("limited", p["limited"]), ("special", p["special"])], "standard")


def edition_name(title: Column, rules: TitleRules = CONSOLE_RULES) -> Column:
    """First edition in list order."""
    return _first_rule(title, rules.editions, "Standard")


def edition_in_title(title: Column, rules: TitleRules = CONSOLE_RULES) -> Column:
    """Edition named earliest in the title; null when none is."""
    ranked = [(label, p, i) for i, (label, p) in enumerate(rules.editions)]
    return _earliest(title, ranked, "value")


def colors(title: Column, rules: TitleRules = CONSOLE_RULES) -> Column:
    """Colours in order of appearance, joined by '/'."""
    if not rules.colors:
        return F.lit("")
    hits = _hits(title, [(label, p, i) for i, (label, p) in enumerate(rules.colors)])
    return F.array_join(F.transform(F.array_sort(hits), lambda h: h["value"]), "/")


def kinect(title: Column, rules: TitleRules = CONSOLE_RULES) -> Column:
    p = rules.patterns
    return F.when(matches(title, p["kinect"]), F.when(matches(title, p["no_kinect"]), F.lit(0)).otherwise(F.lit(1)))


def shell_in_title(shell: Column, shell_words: Column, title: Column) -> Column:
    """Both in plain words: the shell occurs whole, or its first three longer words all do."""
    longer = F.slice(F.filter(shell_words, lambda w: F.length(w) >= 3), 1, 3)
    by_words = (F.size(longer) > 0) & F.forall(longer, lambda w: F.contains(title, w))
    return (shell != "") & (title != "") & (F.contains(title, shell) | by_words)


def plain(title: Column) -> Column:
    return plain_words(title)


def short_name(name: Column, family: Column, strip: dict[str, str]) -> Column:
    """Name without the brand prefix of its family."""
    stripped = None
    for key, pattern in strip.items():
        cut = F.trim(
            F.regexp_replace(
                F.regexp_replace(F.regexp_replace(name, pattern, ""), r"^[\s\[\(\-,]+", ""), r"[\s\]\)]+$", ""
            )
        )
        value = F.when(cut == "", F.lit("Base")).otherwise(cut)
        stripped = F.when(family == key, value) if stripped is None else stripped.when(family == key, value)
    return stripped.otherwise(name)
