"""Saved web pages: embedded JSON, product cards, next-page links."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marketlens import catalog
from marketlens.functions.money import clean_price

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def extract_embedded_json(df: DataFrame, html: str = "html", pattern: str = catalog.EMBEDDED_JSON, schema: str | None = None) -> DataFrame:
    """Adds ``json``, the text of a page's data script, parsed when a schema is given."""
    blob = F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))
    return df.withColumn("json", blob if schema is None else F.from_json(blob, schema))


def has_next_page(html: Column, pattern: str = r"(?is)<a\b[^>]*(?:aria-label=[\"'][^\"']*(?:next|successiv)|\bclass=[\"'][^\"']*\bnext\b)|<a\b[^>]*>[^<]*(?:next|successiv)|<li\b[^>]*class=[\"'][^\"']*\bnext\b[^>]*>\s*<a\b") -> Column:
    return F.coalesce(html, F.lit("")).rlike(pattern)


@dataclass(frozen=True)
class Pick:
    """A value inside a card: the text, or an attribute, of the first element that fits.

    ``tag`` and ``classes`` name the element, ``within`` an ancestor's class; ``attr`` picks an
    attribute instead of the text and must then be present. An empty element fits the card.
    """

    tag: str = ""
    classes: tuple[str, ...] = ()
    within: str = ""
    attr: str = ""


@dataclass(frozen=True)
class CardSpec:
    """Which elements are cards, and the values to pick from each. ``required`` values must be set.

    A card may hold several lines of the same make: ``line`` is the element of a line and
    ``line_fields`` are its values.
    """

    card: Pick
    fields: dict[str, Pick]
    required: tuple[str, ...] = ()
    line: Pick | None = None
    line_fields: dict[str, Pick] = field(default_factory=dict)


class _Scope:
    """A card or line that is being read."""

    def __init__(self, depth: int, fields: dict[str, Pick]):
        self.depth, self.fields, self.values, self.texts, self.lines = depth, fields, {}, {}, []

    def take(self, at: int, tag: str, attrs: dict, inside: Sequence[frozenset]) -> list[str]:
        """Keeps what this element gives; names of the fields whose text is still to come."""
        wanted = []
        for name, pick in self.fields.items():
            itself = at == self.depth
            if name in self.values or name in self.texts or (itself and (pick.tag or pick.classes)) or not _fits(pick, tag, attrs, inside):
                continue
            if pick.attr:
                got = attrs[pick.attr]
                self.values[name] = " ".join(sorted(got)) if pick.attr == "class" else got.strip()
            else:
                self.texts[name] = []
                wanted.append(name)
        return wanted

    def done(self) -> dict:
        return self.values | {k: " ".join("".join(v).split()) for k, v in self.texts.items()}


def _fits(pick: Pick, tag: str, attrs: dict, parents: Sequence[frozenset]) -> bool:
    own = attrs["class"]
    return (
        (not pick.tag or pick.tag == tag)
        and all(c in own for c in pick.classes)
        and (not pick.within or any(pick.within in p for p in parents))
        and (not pick.attr or pick.attr in attrs)
    )


class _CardReader(HTMLParser):
    """Walks one page and keeps the values of each card."""

    def __init__(self, spec: CardSpec):
        super().__init__(convert_charrefs=True)
        self.spec, self.cards, self.stack, self.card, self.line = spec, [], [], None, None

    def handle_starttag(self, tag, attrs):
        named = {k: v or "" for k, v in attrs}
        named["class"] = frozenset(named.get("class", "").split())
        parents, depth = [classes for _, classes, _ in self.stack], len(self.stack)
        if self.card is None and _fits(self.spec.card, tag, named, ()):
            self.card = _Scope(depth, self.spec.fields)
        elif self.card and not self.line and self.spec.line and _fits(self.spec.line, tag, named, parents[self.card.depth:]):
            self.line = _Scope(depth, self.spec.line_fields)
        wanted = [(s, n) for s in (self.card, self.line) if s for n in s.take(depth, tag, named, parents[s.depth:])]
        if tag not in _VOID:
            self.stack.append((tag, named["class"], wanted))

    def handle_data(self, data):
        for _, _, wanted in self.stack:
            for scope, name in wanted:
                scope.texts[name].append(data)

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.stack):
            while self._leave() != tag:
                pass

    def close(self):
        super().close()
        while self.stack:
            self._leave()

    def _leave(self) -> str:
        tag, _, _ = self.stack.pop()
        if self.line and len(self.stack) <= self.line.depth:
            self.card.lines.append(self.line.done())
            self.line = None
        if self.card and len(self.stack) <= self.card.depth:
            values = self.card.done()
            if all(values.get(r) for r in self.spec.required):
                self.cards.append(values | {"lines": self.card.lines})
            self.card = None
        return tag


def extract_cards(pages: DataFrame, spec: CardSpec, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per card and page: key, ``card_no`` and the spec's fields as text.

    With line fields there is also ``lines``, an array of structs.
    """
    card = [f"`{f}`:string" for f in spec.fields]
    if spec.line:
        card.append("lines:array<struct<" + ",".join(f"`{f}`:string" for f in spec.line_fields) + ">>")

    @F.pandas_udf(f"array<struct<{','.join(card)}>>")
    def read(html: pd.Series) -> pd.Series:
        def cards(text: str | None) -> list[dict]:
            reader = _CardReader(spec)
            reader.feed(text or "")
            reader.close()
            plain = [{f: c.get(f) for f in spec.fields} for c in reader.cards]
            if spec.line:
                for out, c in zip(plain, reader.cards):
                    out["lines"] = [{f: line.get(f) for f in spec.line_fields} for line in c["lines"]]
            return plain

        return html.map(cards, na_action=None)

    # Keys stay outside Python.
    found = pages.select(key, F.posexplode(read(html)).alias("card_no", "_card"))
    return found.select(key, F.col("card_no").cast("long").alias("card_no"), "_card.*")


def cards_to_offers(cards: DataFrame, source: str, *, condition: Column, available: Column, sku: Column, price: str = "price_text") -> DataFrame:
    return cards.select(
        "*", clean_price(F.col(price)).alias("price"), condition.alias("condition"), available.alias("available"), sku.alias("sku"), F.lit(source).alias("source")
    )


def lines_of(cards: DataFrame) -> DataFrame:
    """Lines of two-condition cards in the form ``two_condition_cards`` takes."""
    line = lambda x: F.struct(
        F.coalesce(x["available"], x["unavailable"]).alias("label"), x["available"].isNotNull().alias("in_stock"), x["price_text"].alias("price_text")
    )
    base = F.regexp_replace(F.regexp_extract(F.coalesce("image_alt", F.lit("")), r"^\[([^\]]+)\]", 1), r"(?i)_[UN]$", "")
    slug = F.element_at(F.split(F.regexp_replace(F.coalesce("url", F.lit("")), "/+$", ""), "/"), -1)
    return cards.withColumn("lines", F.transform("lines", line)).withColumn("base_sku", F.when(base != "", base).otherwise(slug))


# --- fixed values: card layouts of the known stores -----------------------------------------
GAMESHOCK = CardSpec(
    Pick(classes=("ajax_block_product",)),
    {
        "title": Pick("a", within="", attr="title"), "url": Pick("a", attr="href"), "name": Pick("h3"),
        "price_text": Pick(classes=("price",)), "image_url": Pick("img", attr="src"), "availability": Pick(classes=("availability",)),
    },
    ("url",),
)
REBUY = CardSpec(
    Pick(classes=("ry-card",)),
    {
        "name": Pick(classes=("title",)), "url": Pick("a", attr="href"), "image_url": Pick("img", attr="src"), "text": Pick(), "card_class": Pick(attr="class"),
    },
    ("name", "url"),
)
JOLLYROGERBAY = CardSpec(
    Pick(classes=("js-product", "product")),
    {
        "product_id": Pick("article", ("product-miniature",), attr="data-id-product"),
        "attribute_id": Pick("article", ("product-miniature",), attr="data-id-product-attribute"),
        "title": Pick("a", within="product-title", attr="title"), "name": Pick("a", within="product-title"), "url": Pick("a", within="product-title", attr="href"),
        "price_text": Pick("span", ("price",)), "image_url": Pick("img", within="thumbnail-container", attr="src"),
    },
    ("url",),
)
GAMEPEOPLE = CardSpec(
    Pick(classes=("lista_prodotto",)),
    {
        "name": Pick("a", within="lista_prodotto_titolo"), "url": Pick("a", within="lista_prodotto_titolo", attr="href"),
        "price_text": Pick(classes=("prezzo_finale",)), "availability": Pick("span", ("bold",), within="float_right"),
        "stock_image": Pick("img", within="float_right", attr="src"), "text": Pick(),
    },
    ("name",),
)
GAMELIFE = CardSpec(
    Pick(classes=("o_wsale_product_grid_wrapper",)),
    {
        "name": Pick("form", attr="aria-label"), "url": Pick("a", attr="href"), "image_alt": Pick("img", ("oe_product_image_img",), attr="alt"),
        "image_url": Pick("img", ("oe_product_image_img",), attr="src"), "ribbon": Pick(classes=("o_ribbons",)),
    },
    ("name",),
    Pick(classes=("row",), within="justify-content-center"),
    {"available": Pick("span", ("available",)), "unavailable": Pick("span", ("unavailable",)), "price_text": Pick(classes=("oe_currency_value",))},
)
