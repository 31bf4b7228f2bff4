"""Byte-level BPE by longest matches and backtracking, and its inverse.

A vocabulary is a file of base64 tokens with their ranks, the rank being the id.
Texts are first split by a pattern; every piece is encoded for itself:

* The bytes of a piece, read as Latin-1, go through an Aho-Corasick automaton
  of all tokens, which gives the longest token that starts at each byte.
* A sequence of tokens is what merging by rank gives if and only if every two
  adjacent tokens are: merging their joined bytes gives these two again. Such
  a pair is judged by undoing merges along the seam, and the answer is kept.
* From the left, the longest token that is compatible with the one before is taken;
  where none is, the position is marked dead and the last token is replaced by
  its longest prefix among the tokens. No position dies twice, so the work is
  linear in the piece.

Encodings of short pieces are kept in each Python worker, in two generations of ``kept`` pieces (about 250 bytes each):
when the younger is full it becomes the older, and what is met again moves to the younger.
Encoding is a Column function from text to the ids as little-endian unsigned
32-bit integers, decoding one from those to bytes; both are narrow. A null text
counts as an empty one, which has no ids. The vocabulary is read by the
tasks from ``path``, which must exist on every executor.
"""

from __future__ import annotations

import base64
from array import array
from functools import cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

KEPT = 400_000
LONG_PIECE = 64
LONG_TEXT = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Encodes pieces of bytes by the ranks of a vocabulary that holds every single byte."""

    def __init__(self, ranks: dict[bytes, int], kept: int = KEPT):
        self.ranks, self.kept = ranks, kept
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = [len(token) for token in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = [self._longest_prefix(token) for token in self.tokens]
        self.halves: list[tuple[int, int]] = [(rank, rank) for rank in range(len(self.tokens))]
        self.merged: dict[tuple[int, int], int] = {}
        self.judged: dict[int, bool] = {}
        for rank in sorted(ranks.values()):
            self._find_halves(rank)
        self.judged.clear()

    def _longest_prefix(self, token: bytes) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        for size in range(len(token) - 1, 0, -1):
            rank = self.ranks.get(token[:size])
            if rank is not None:
                return rank
        return -1

    def _find_halves(self, rank: int) -> None:
        """Which two tokens the merge of this rank joins."""
        token, left = self.tokens[rank], self.shorter[rank]
        while left >= 0:
            right = self.ranks.get(token[self.sizes[left] :])
            if right is not None and left < rank and right < rank and self._seam_holds(left, right):
                self.halves[rank] = (left, right)
                self.merged[left, right] = rank
                return
            left = self.shorter[left]

    def _seam_holds(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both by rank leaves these two tokens.

        Undoes the merges next to the seam, latest first. The seam breaks if at
        some moment the tokens at both sides had a merge that comes before the
        one undone last. Of equal merges, the one further left comes first.
        """
        before = len(self.tokens) + 1
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            inner_left, inner_right = self.halves[left][1], self.halves[right][0]
            if inner_left == left and inner_right == right:
                return True
            if inner_right == right or (left > right and inner_left != left):
                before, left = left, inner_left
            else:
                before, right = right + 1, inner_right

    def _judge(self, left: int, right: int) -> bool:
        """``_seam_holds``, remembered for up to ``kept`` pairs."""
        if len(self.judged) >= self.kept:
            self.judged.clear()
        answer = self.judged[left << 32 | right] = self._seam_holds(left, right)
        return answer

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        sizes, shorter, n = self.sizes, self.shorter, len(piece)
        known, judge = self.judged.get, self._judge
        longest = [-1] * (n + 1)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - sizes[token]] = token
        dead = bytearray(n + 1)
        taken: list[int] = []
        at, last, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                if not dead[at + sizes[token]]:
                    if last < 0:
                        break
                    fits = known(last << 32 | token)
                    if fits or (fits is None and judge(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                at += sizes[token]
                last, token = token, longest[at]
            else:
                dead[at] = 1
                token = taken.pop()
                last = taken[-1] if taken else -1
                at -= sizes[token]
                token = shorter[token]
        return taken


class Pieces(dict):
    """From the text of a piece to its packed ids."""

    def __init__(self, encoder: Encoder, kept: int):
        super().__init__()
        self.encoder, self.kept = encoder, kept
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = array("I", self.encoder.encode(piece.encode())).tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self) >= self.kept:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, path: str, pattern: str, kept: int = KEPT):
        self.split = regex.compile(pattern)
        self.encoder = Encoder(read_ranks(path), kept)
        self.pieces = Pieces(self.encoder, kept)

    def encode(self, text: str) -> bytes:
        look = self.pieces.__getitem__
        if len(text) <= LONG_TEXT:
            return b"".join(map(look, self.split.findall(text)))
        found, parts = self.split.finditer(text), []
        while block := b"".join(look(m[0]) for m in islice(found, LONG_TEXT)):
            parts.append(block)
        return b"".join(parts)

    def decode(self, packed: bytes) -> bytes:
        token, parts = self.encoder.tokens.__getitem__, []
        for at in range(0, len(packed), 4 * LONG_TEXT):
            ids = np.frombuffer(packed[at : at + 4 * LONG_TEXT], "<u4").tolist()
            parts.append(b"".join(map(token, ids)))
        return b"".join(parts)


@cache
def _codec(path: str, pattern: str, kept: int) -> Codec:
    return Codec(path, pattern, kept)


def encode(text: Column, path: str, pattern: str, kept: int = KEPT) -> Column:
    """The packed ids of a text; ``kept`` trades memory of the workers for time."""

    @F.arrow_udf(BinaryType())
    def encoded(texts: pa.Array) -> pa.Array:
        codec = _codec(path, pattern, kept)
        return pa.array([codec.encode(t or "") for t in texts.to_pylist()], pa.binary())

    return encoded(text)


def decode(packed: Column, path: str, pattern: str, kept: int = KEPT) -> Column:
    """The bytes that packed ids stand for; null gives none."""

    @F.arrow_udf(BinaryType())
    def decoded(ids: pa.Array) -> pa.Array:
        codec = _codec(path, pattern, kept)
        return pa.array([codec.decode(i or b"") for i in ids.to_pylist()], pa.binary())

    return decoded(packed)
