"""Toxicity by a support vector machine over a subsequence string kernel.

Words (and letters spelt out one by one, joined) are strings over a small alphabet with marks at
both ends. The kernel of two strings sums over their common subsequences of three characters,
each occurrence weighted by a decay to the power of the length it spans, so gaps and inserted
characters cost little. Nystroem landmarks, some toxic and some clean words, give every string a
vector; a linear support vector machine is trained on these. A linear function of kernel values
is itself linear in the subsequences, so a trained model is one table of weights per
subsequence. A sentence is as toxic as its worst string, a document as its worst sentence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marketlens.session import settle

_LETTERS, _SIZE = 26, 41
_ENDS = re.compile(r"(?<=[.!?])\s+|\n+")
#: Subsequences span at most so many characters; longer strings are read in windows.
SPAN, WINDOW, DECAY = 8, 32, 0.7
#: Subsequences that are held at once.
_PART = 1 << 18
_FLOOR = -1.0


def letters_of(word: str) -> str:
    """Lower case, letters alone: marks put between letters vanish."""
    low = word.lower()
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def strings_of(words: list[str]) -> list[str]:
    """The words of a sentence and each run of three or more single characters, joined."""
    if sum(len(w) <= 2 for w in words) < 3:
        return words
    out, run = list(words), []
    for word in [*words, "   "]:
        if len(word) == 1 or len(word) == 2 and not word.isalnum():
            run.append(word)
        else:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
    return out


def _codes(words: list[str]) -> np.ndarray:
    """(n, length + 2) codes of strings of one length, with marks at both ends."""
    length = len(words[0])
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length).astype(np.int64)
    plain = (points >= 97) & (points < 97 + _LETTERS)
    inner = np.where(plain, points - 96, 27 + points % (_SIZE - 29))
    ends = np.zeros((len(words), 1), np.int64)
    return np.hstack([ends, inner, ends + _SIZE - 1])


@cache
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all triples of ``n`` characters within the span, and their weights."""
    places = np.array([t for t in combinations(range(n), 3) if t[2] - t[0] < SPAN], np.int64).reshape(-1, 3)
    return places, DECAY ** (places[:, 2] - places[:, 0] + 1.0)


def windows(word: str) -> list[str]:
    """A string of letters in windows that hold every subsequence within the span."""
    if len(word) <= WINDOW:
        return [word] if len(word) >= 2 else []
    return [word[i:i + WINDOW] for i in range(0, len(word) - SPAN, WINDOW - SPAN)]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        # Long strings have many subsequences each; a part has at most some _PART of them.
        step = max(16, min(4096, _PART // max(1, len(_triples(int(n))[1]))))
        for i in range(0, len(at), step):
            part = at[i:i + step]
            yield part, [words[j] for j in part]


def _subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, t) and weights (t) of the subsequences of strings of one length."""
    codes = _codes(words)
    places, weights = _triples(codes.shape[1])
    a, b, c = (codes[:, places[:, k]] for k in range(3))
    return (a * _SIZE + b) * _SIZE + c, weights


def _self_kernel(triples: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Kernel of each string with itself: equal subsequences add up before squaring."""
    order = np.argsort(triples, axis=1, kind="stable")
    ranked, held = np.take_along_axis(triples, order, 1), weights[order]
    total = np.cumsum(held, axis=1)
    last = np.ones(ranked.shape, bool)
    last[:, :-1] = ranked[:, 1:] != ranked[:, :-1]
    out = np.zeros(len(ranked))
    for i in range(len(ranked)):
        sums = np.diff(total[i, last[i]], prepend=0.0)
        out[i] = sums @ sums
    return out


def explicit(words: list[str]) -> np.ndarray:
    """Rows of unit length in the space of all subsequences; for few strings."""
    out = np.zeros((len(words), _SIZE**3), np.float32)
    for at, part in _by_length(words):
        triples, weights = _subsequences(part)
        for i, row in zip(at, triples):
            np.add.at(out[i], row, weights)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out


def _weighted(table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sum of the rows of ``table`` in double precision, some columns at a time: the table is large."""
    step = 1 << 14
    return np.concatenate([table[:, i:i + step].T @ weights for i in range(0, table.shape[1], step)])


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Normalised subsequence kernel of all strings of ``left`` with those of ``right``."""
    table = explicit(right)
    out = np.zeros((len(left), len(right)))
    for i in range(0, len(left), 64):
        out[i:i + 64] = explicit(left[i:i + 64]) @ table.T
    return out


@dataclass
class Model:
    """Weights of subsequences, bias, and the logistic curve from margins to scores."""

    table: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    _known: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"table": self.table, "bias": self.bias, "slope": self.slope, "shift": self.shift, "_known": {}}

    @cached_property
    def _least(self) -> float:
        return min(_FLOOR, self.bias)

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each string of letters (at most a window long), at least the floor."""
        out = np.full(len(words), _FLOOR)
        for at, part in _by_length(words):
            triples, weights = _subsequences(part)
            raw = self.table[triples] @ weights
            # A string's own kernel is at least the sum of its squared weights: most stay below the floor.
            some = np.flatnonzero(raw / np.sqrt(weights @ weights) + self.bias > _FLOOR)
            if len(some):
                out[at[some]] = np.maximum(_FLOOR, raw[some] / np.sqrt(_self_kernel(triples[some], weights)) + self.bias)
        return out

    def worst(self, texts: list[str | None], remember: int = 400_000) -> list[float]:
        """The largest margin among the strings of each text; the floor where there is none."""
        known, out = self._known, []
        for at in range(0, len(texts), 256):
            group = [self._strings(t) for t in texts[at:at + 256]]
            if len(known) > remember:
                known.clear()
            new = list(set().union(*group).difference(known))
            parts = [windows(letters_of(w)) for w in new]
            flat = sorted({p for ps in parts for p in ps})
            margin = dict(zip(flat, self.margins(flat).tolist())) if flat else {}
            fresh = {w: max((margin[p] for p in ps), default=_FLOOR) for w, ps in zip(new, parts)}
            known.update(fresh)
            out += [max(map(known.__getitem__, strings), default=_FLOOR) for strings in group]
        return out

    @staticmethod
    def _strings(text: str | None) -> list[str]:
        return [] if not text else [s for line in text.split("\n") for s in strings_of(line.split())]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.slope * np.array(self.worst(texts), float) + self.shift)))

    def sentences(self, text: str) -> list[tuple[str, float]]:
        """Each sentence of a text with its score."""
        parts = [s for s in _ENDS.split(text) if s.strip()]
        return list(zip(parts, self.scores(parts).tolist()))


# ---- training ---------------------------------------------------------------------------


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last column of x is the bias."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], 1.0)
    penalty[-1] = 1e-6
    for _ in range(60):
        active = y * (x @ w) < 1
        xa = x[active]
        new = np.linalg.solve(np.diag(penalty) + (xa * cost[active, None]).T @ xa, xa.T @ (cost[active] * y[active]))
        if np.allclose(new, w, atol=1e-7):
            break
        w = 0.5 * w + 0.5 * new
    return w


def _disguised(word: str, random: np.random.Generator) -> list[str]:
    """A toxic string with a letter put in, doubled or left out."""
    if not 4 <= len(word) < WINDOW:
        return []
    at = random.integers(1, len(word), 4)
    letter = [chr(97 + k) for k in random.integers(0, _LETTERS, 2)]
    put_in = [word[:i] + c + word[i:] for i, c in zip(at, letter)]
    return [*put_in, word[:at[2]] + word[at[2] - 1] + word[at[2]:], word[:at[3]] + word[at[3] + 1:]]


def train(toxic: list[str], clean: list[str], landmarks: int = 192, rounds: int = 4, cost: float = 10.0) -> Model:
    """A model from toxic and clean strings, the likeliest toxic ones first.

    Half of the landmarks are toxic strings, half clean ones; each round adds the clean strings
    that came out worst to the training rows, half of the landmarks among them.
    """
    if not toxic or not clean:
        return Model(np.zeros(_SIZE**3), _FLOOR)
    toxic, clean = [w for w in toxic if 2 <= len(w) <= WINDOW], sorted({w for w in clean if 2 <= len(w) <= WINDOW} - set(toxic))
    random = np.random.default_rng(5)
    plain = toxic
    toxic = list(dict.fromkeys(toxic + [v for w in toxic for v in _disguised(w, random)]))
    used = [clean[i] for i in random.permutation(len(clean))[:3000]]
    hard: list[str] = []
    table = None
    for _ in range(rounds):
        del table  # one table at a time
        marks = plain[: landmarks // 2]
        marks = marks + list(dict.fromkeys(hard[: landmarks // 4] + used))[: landmarks - len(marks)]
        table = explicit(marks)
        gram = (table @ table.T).astype(float)
        values, vectors = np.linalg.eigh(gram)
        some = values > 1e-6 * values[-1]
        root = vectors[:, some] / np.sqrt(values[some])
        rows = toxic + used
        x = np.vstack([explicit(rows[i:i + 64]) @ table.T for i in range(0, len(rows), 64)]) @ root
        y = np.r_[np.ones(len(toxic)), -np.ones(len(used))]
        weight = np.where(y > 0, cost * len(used) / max(1, len(toxic)) / 4, cost)
        w = _machine(np.hstack([x, np.ones((len(x), 1))]), y, weight)
        model = Model(_weighted(table, root @ w[:-1]), float(w[-1]))
        margin = model.margins(clean)
        hard = [clean[i] for i in np.argsort(-margin)[:800] if margin[i] > -0.8]
        used = list(dict.fromkeys(used + hard))
    return model


def _logistic(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    x, w = np.c_[margin, np.ones(len(margin))], np.array([1.0, 0.0])
    prior = np.diag([0.1, 0.01])  # keeps the curve flat enough for margins between the classes
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + prior, x.T @ (weight * (label - p)) - prior @ w)
        w = w + np.clip(step, -2, 2)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def _units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strings of letters of each labelled text, with a hash of the words beside them."""
    for frame in frames:
        rows = set()
        for text, toxic in zip(frame["_text"], frame["_toxic"]):
            for line in (text or "").split("\n"):
                words = strings_of(line.split())
                for before, word, after in zip(["", *words], words, [*words[1:], ""]):
                    context = zlib.crc32(f"{before} {after}".encode())
                    rows.update((p, context, bool(toxic)) for p in windows(letters_of(word)))
        yield pd.DataFrame(sorted(rows), columns=["unit", "context", "toxic"])


def fit(
    docs: DataFrame, labels: DataFrame, held_out: Column | None = None, label_col: str = "toxic", id_col: str = "doc_id",
    text_col: str = "text", train_docs: int = 3000, toxic_units: int = 400, clean_units: int = 60_000,
) -> Model:
    """A model from the labelled documents for which ``held_out`` (over ``id_col``) is not true.

    At most ``train_docs`` documents of each class are used, those with the lowest hash of
    their id. A toxic document does not say which sentence is toxic: the toxic strings are the
    ones found in more places of toxic documents than chance allows (three standard deviations
    above their share in clean ones, and nine times as often), at most ``toxic_units``; at most ``clean_units`` strings of
    clean documents stand against them. Without labels of both kinds all scores are 0.5 or less.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if held_out is not None:
        known = known.where(~held_out)
    known = known.select(F.col(id_col).alias("_label_id"), (F.col(label_col) == 1).alias("_toxic"))
    sizes = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    chosen = None
    for kind in (True, False):
        part = known.where(F.col("_toxic") == kind).orderBy(F.xxhash64("_label_id"), "_label_id").limit(train_docs)
        chosen = part if chosen is None else chosen.union(part)
    # At most twice ``train_docs`` ids.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(chosen), F.col("_id") == F.col("_label_id")
    ).select("_text", "_toxic")
    texts = settle(texts.repartition(24, F.xxhash64("_text")))
    found = {r["_toxic"]: r["count"] for r in texts.groupBy("_toxic").count().collect()}
    if len(found) < 2:
        return Model(np.zeros(_SIZE**3), _FLOOR)
    ratio = found[True] / found[False]
    # Contexts are counted, not documents: copies repeat the words around a word, insults do not.
    contexts = texts.mapInPandas(_units, "unit string, context long, toxic boolean").groupBy("unit", "context").agg(
        F.max("toxic").alias("in_toxic"), F.max(~F.col("toxic")).alias("in_clean")
    )
    units = settle(contexts.groupBy("unit").agg(
        F.sum(F.col("in_toxic").cast("int")).alias("t"), F.sum(F.col("in_clean").cast("int")).alias("c")
    ))
    z = (F.col("t") - F.col("c") * ratio) / F.sqrt(F.col("t") + F.col("c") * ratio * ratio + 1.0)
    bad = [r["unit"] for r in units.where((z >= 3) & (F.col("t") >= 9 * ratio * F.col("c")) & (F.length("unit") >= 3)).orderBy(z.desc(), "unit").limit(toxic_units).collect()]
    good = [r["unit"] for r in units.where((F.col("c") > 0) & (z < 1)).orderBy(F.xxhash64("unit"), "unit").limit(clean_units).collect()]
    model = train(bad, good)

    def margins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"margin": model.worst(list(frame["_text"])), "toxic": frame["_toxic"]})

    seen = texts.mapInPandas(margins, "margin double, toxic boolean").toPandas()
    toxic = seen["toxic"].to_numpy(bool)
    weight = np.where(toxic, sizes[True] / found[True], sizes[False] / found[False])
    model.slope, model.shift = _logistic(seen["margin"].to_numpy(), toxic.astype(float), weight / weight.mean())
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1. Null and empty texts get the lowest score.

    Every row is scored by its text alone, so repeated rows get equal scores; all columns stay
    and an empty table gives no rows. A column of the name ``out`` is replaced.
    """
    sc = docs.sparkSession.sparkContext.broadcast(model)  # one table of fixed size

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(sc.value.scores(list(texts)))

    return docs.withColumn(out, scored(F.col(text_col)))
