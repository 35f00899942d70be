"""Encoding and decoding with a BPE model of sentencepiece, by a table over prefixes.

Every prefix of a word has exactly one last token in its merge encoding: the token ending there
(found by an automaton over all pieces) that is compatible with the last token of the prefix
before it. Two tokens are compatible if merging their joint text gives back these two. Ids are
read from the table backwards. No piece holds a space mark behind another character, so words
are encoded one by one, each once while it stays in memory.
"""

from __future__ import annotations

import codecs
from collections.abc import Container, Iterator
from functools import cache
from itertools import chain

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from marketlens.llm.memo import Memo

MARK = "▁"
codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class Vocabulary:
    """Pieces, scores and kinds of a model file with one space mark in front of the text."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.normal = {self.pieces[i]: i for i in ids if i not in special}
        self.scores = {self.pieces[i]: model.get_score(i) for i in ids if i not in special}
        self.control = {i for i in ids if model.is_control(i)}
        self.end_id = model.eos_id()
        inner = [p for p in self.normal if MARK in p.lstrip(MARK) or (p.strip(MARK) and p.startswith(MARK * 2))]
        if inner:
            raise ValueError(f"pieces with a space mark inside are not supported: {inner[:3]}")

        #: Marks that no piece holds behind a letter.
        self.apart = {c for c in ".,;:!?" if not any(a.isalpha() and b == c for p in self.normal for a, b in zip(p, p[1:]))}
        self._lines = all("\n" not in p for p in self.normal)

    def chunks(self, text: str) -> list[str] | None:
        """Parts of a text that no piece spans, space marks in front; None if spaces come in runs.

        Parts begin at space marks and, where no piece holds a line end, at line ends.
        """
        if "\0" in text or MARK in text or "  " in text or text[-1] == " " or text[0] == " ":
            return None
        marked = (MARK + text).replace(" ", "\0" + MARK)
        return (marked.replace("\n", "\0\n") if self._lines else marked).split("\0")

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for piece, i in self.normal.items():
            found.add_word(piece, (len(piece), i))
        found.make_automaton()
        return found


def _merge_run(n: int, lengths: Container[int]) -> list[int]:
    """Lengths of the pieces that merging ``n`` equal characters leaves, leftmost first."""
    parts = [1] * n
    while (at := next((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in lengths), None)) is not None:
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def split_words(text: str) -> list[tuple[int, str]]:
    """(space marks, word) from the front; the last word is empty if spaces end the text."""
    out, run = [], 0
    for word in text.replace(MARK, " ").split(" "):
        run += 1
        if word:
            out.append((run, word))
            run = 0
    if run:
        out.append((run, ""))
    return out


class PieceCodec:
    """``encode`` and ``decode`` of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str, remember: int = 300_000):
        v = self.vocabulary = Vocabulary(path)
        self._automaton, self._compatible = v.automaton(), Memo(self._test, 400_000)
        self._derived = Memo(lambda i: self._derive(v.pieces[i]), len(v.pieces))
        self._runs = {len(p): i for p, i in v.normal.items() if not p.strip(MARK)}
        single = [s for p, s in v.scores.items() if p.strip(MARK) and len(p) > 1]
        others = [s for p, s in v.scores.items() if not p.strip(MARK) and len(p) > 1]
        if len(set(single)) < len(single) or (others and single and max(others) >= min(single)):
            raise ValueError("merges of equal rank are supported for runs of space marks alone")
        self._longest_run = max(self._runs)
        if _merge_run(2 * self._longest_run, self._runs)[0] != self._longest_run:
            raise ValueError("the longest run of space marks cannot be merged")
        self._chunks = Memo(self._encode_chunk, remember)
        self._bytes = [p.replace(MARK, " ").encode() for p in v.pieces]
        for b, i in enumerate(v.byte_ids):
            self._bytes[i] = bytes([b])
        for i in v.control:
            self._bytes[i] = b""

    # ---- encoding

    def _derive(self, piece: str) -> tuple[bool, list[tuple[str, float]], list[tuple[str, float]]]:
        """How merging forms a piece: whether it comes out whole, and its two edges.

        An edge lists the tokens that stand at that side of the piece while it is formed, from
        the outer character to the whole, each with the level at which the next one replaces
        it. The level of a token is the worst score used to form it: merges happen from the
        best level to the worst.
        """
        parts, scores = [(c, float("inf")) for c in piece], self.vocabulary.scores
        left, right = [parts[0][0]], [parts[-1][0]]
        left_at, right_at = [], []
        while len(parts) > 1:
            at, best = -1, None
            for i in range(len(parts) - 1):
                now = scores.get(parts[i][0] + parts[i + 1][0])
                if now is not None and (best is None or now > best):
                    at, best = i, now
            if at < 0:
                return False, [], []
            joined = (parts[at][0] + parts[at + 1][0], min(best, parts[at][1], parts[at + 1][1]))
            if at == 0:
                left.append(joined[0]), left_at.append(joined[1])
            if at == len(parts) - 2:
                right.append(joined[0]), right_at.append(joined[1])
            parts[at:at + 2] = [joined]
        never = [float("-inf")]
        return True, list(zip(left, left_at + never)), list(zip(right, right_at + never))

    def _test(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens stay two when their joint text is merged (-1: nothing before)."""
        whole, edge, _ = self._derived[pair[1]]
        if pair[0] < 0 or not whole:
            return whole
        scores, before = self.vocabulary.scores, self._derived[pair[0]][2]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = before[i], edge[j]
            across = scores.get(x + y)
            # It merges across unless x or y is taken before; of equal scores the left one goes first.
            if across is not None and across > x_ends and across >= y_ends:
                return False
            if i + 1 == len(before) and j + 1 == len(edge):
                return True
            if x_ends >= y_ends:
                i += 1
            else:
                j += 1

    def _encode_chunk(self, text: str) -> tuple[int, ...]:
        """Ids of a text with at most one space mark, in front."""
        if len(text) > 2 and text[-1] in self.vocabulary.apart and text[-2].isalpha():
            return self._chunks[text[:-1]] + self._chunks[text[-1]]
        compatible, n = self._compatible, len(text)
        last, lengths = [-1] * (n + 1), [1] * (n + 1)
        for end, (length, i) in self._automaton.iter(text):
            end += 1
            # -1 stands for the text's beginning or an unknown character: nothing merges across.
            if last[end] < 0 and compatible[last[end - length], i]:
                last[end], lengths[end] = i, length
        out, at = [], n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out.extend(self.vocabulary.byte_ids[b] for b in reversed(text[at - 1].encode()))
            at -= lengths[at]
        return tuple(reversed(out))

    def _run(self, n: int) -> list[int]:
        """Ids of space marks alone. All such merges have one rank, so the leftmost goes first."""
        full = max(0, n // self._longest_run - 1)
        return [self._runs[self._longest_run]] * full + [self._runs[k] for k in _merge_run(n - full * self._longest_run, self._runs)]

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text, with neither a beginning nor an end id."""
        if not text:
            return []
        chunks = self.vocabulary.chunks(text)
        if chunks is not None:
            return list(chain.from_iterable(map(self._chunks.__getitem__, chunks)))
        out, mark = [], self._runs[1]
        for run, word in split_words(text):
            ids = self._chunks[MARK + word] if word else ()
            if not word:
                out += self._run(run)
            elif run == 1:
                out += ids
            elif ids[0] == mark:
                out += self._run(run)
                out += ids[1:]
            else:
                out += self._run(run - 1)
                out += ids
        return out

    # ---- decoding

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids vanish, byte ids are joined, one space in front is dropped."""
        first = next((i for i in ids if i not in self.vocabulary.control), None)
        joined = b"".join(map(self._bytes.__getitem__, ids))
        if first is not None and self.vocabulary.pieces[first].startswith(MARK):
            joined = joined[1:]
        return joined.decode("utf-8", "each_byte")


@cache
def piece_codec(path: str) -> PieceCodec:
    """One codec per process: what it remembers serves all tasks there."""
    return PieceCodec(path)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """One row per document: id and ``ids``. Null and empty texts give the end id alone.

    Repeated rows stay repeated, an empty table gives no rows, other columns are not read.
    """
    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = piece_codec(model)
        tail = [codec.vocabulary.end_id] if end else []
        for texts in batches:
            yield pd.Series([codec.encode(t) + tail for t in texts], dtype=object)

    return docs.select(F.col(id_col), ids(F.col(text_col)).alias("ids"))


def decode_documents(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id and the decoded ``text``; null ids decode to an empty text."""
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = piece_codec(model)
        for rows in batches:
            yield pd.Series([codec.decode([] if i is None else list(i)) for i in rows], dtype=object)

    return rows.select(F.col(id_col), text(F.col(ids_col)).alias("text"))


def round_trip(docs: DataFrame, model: str, digest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: id and the columns of ``digest(ids, text)``.

    ``digest`` maps the ids and the decoded text to (n_tokens, ids_sha256, decoded_sha256), so
    that neither leaves the task.
    """
    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both_ways(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = piece_codec(model)
        for texts in batches:
            rows = []
            for text in texts:
                ids = codec.encode(text)
                ids.append(codec.vocabulary.end_id)
                rows.append(digest(ids, codec.decode(ids)))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    # Ids stay outside Python, which would make doubles of ids beside a null one.
    return docs.select(F.col(id_col), both_ways(F.col(text_col)).alias("_both")).select(F.col(id_col), "_both.*")
