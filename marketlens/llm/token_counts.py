"""Token counts of a unigram vocabulary by a Viterbi pass that keeps counts only.

An automaton enumerates the pieces that end at each position, longest first. Each position
carries the best score and the number of pieces on the way to it. Ties follow the tokenizer: of
equal scores the candidate with the earliest start stays. A character without a piece of its
own costs ten less than the worst piece and falls back to its bytes. Scores are sums in double
precision, and no piece holds a space mark behind another character, so words are counted one
by one with the result of one pass over the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marketlens.llm.memo import Memo
from marketlens.llm.sentencepiece_codec import MARK, Vocabulary, split_words

_UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    """Number of unigram tokens of texts, from the pieces and scores of a model file."""

    def __init__(self, path: str, remember: int = 300_000):
        v = self._vocabulary = Vocabulary(path)
        self._automaton, self._single = v.automaton(), {p for p in v.normal if len(p) == 1}
        self._score = [0.0] * len(v.pieces)
        for piece, i in v.normal.items():
            self._score[i] = v.scores[piece]
        self._unknown = min(v.scores.values()) - _UNKNOWN_PENALTY
        self._memo = Memo(self._chunk, remember)

    def _chunk(self, text: str) -> int:
        # No piece spans a letter and such a mark, so the best paths on both sides are independent.
        if len(text) > 2 and text[-1] in self._vocabulary.apart and text[-2].isalpha():
            return self._memo[text[:-1]] + self._memo[text[-1]]
        return self.viterbi(text)[1]

    def viterbi(self, text: str) -> tuple[float, int]:
        """(score, pieces) of the best path over a text of words behind space marks."""
        n, score = len(text), self._score
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        matches = iter(self._automaton.iter(text))
        at = next(matches, None)
        for end in range(1, n + 1):
            top = None
            while at is not None and at[0] == end - 1:
                length, i = at[1]
                start = end - length
                now = best[start] + score[i]
                if top is None or now > top:
                    top, count = now, pieces[start] + 1
                at = next(matches, None)
            if text[end - 1] not in self._single:
                now = best[end - 1] + self._unknown
                if top is None or now > top:
                    top, count = now, pieces[end - 1] + len(text[end - 1].encode())
            best[end], pieces[end] = top, count
        return best[n], pieces[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        memo = self._memo
        chunks = self._vocabulary.chunks(text)
        if chunks is not None:
            return sum(map(memo.__getitem__, chunks))
        return sum(memo[MARK * run + word] for run, word in split_words(text))


@cache
def unigram_counter(path: str) -> UnigramCounter:
    """One counter per process: what it remembers serves all tasks there."""
    return UnigramCounter(path)


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``n_tokens`` (no special ids). Null and empty texts have 0.

    Repeated rows stay repeated, an empty table gives no rows, other columns are not read.
    """
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = unigram_counter(model)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    # Ids stay outside Python, which would make doubles of ids beside a null one.
    return docs.select(F.col(id_col), count(F.col(text_col)).alias("n_tokens"))
