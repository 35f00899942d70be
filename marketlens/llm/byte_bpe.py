"""Ids of a byte-level BPE tokenizer."""

from __future__ import annotations

import json
from array import array
from functools import cache

import tiktoken

# The split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """Encoder of a ``tokenizers`` byte-level BPE file.

    The added tokens of the file are cut out of a text before it is split, as ``tokenizers`` does
    whether or not it puts special tokens around the text.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        vocabulary, added = read["model"]["vocab"], read.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in or look at the characters beside them are not supported")
        self._added = {t["content"]: t["id"] for t in added}
        back = _byte_of_character()
        ranks = {bytes(back[c] for c in piece): i for piece, i in vocabulary.items() if all(c in back for c in piece)}
        whole = {content.encode() for content in self._added}
        ranks = {piece: i for piece, i in ranks.items() if piece not in whole}
        self._ranks = ranks
        self._encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self._added)

    def plain_ids(self, text: str) -> list[int]:
        """Ids of a text in which the strings of added tokens are plain text."""
        return self._encoding.encode_ordinary(text)

    def bytes_of(self, ids: list[int]) -> bytes:
        return self._encoding.decode_bytes(ids)

    def pieces(self) -> dict[int, bytes]:
        """Bytes by id, without the added tokens."""
        return {i: piece for piece, i in self._ranks.items()}

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if any(content in text for content in self._added):
            return array("I", self._encoding.encode(text, allowed_special="all")).tobytes()
        return array("I", self._encoding.encode_ordinary(text)).tobytes()


@cache
def byte_bpe(path: str) -> ByteBpe:
    """One encoder per process."""
    return ByteBpe(path)
