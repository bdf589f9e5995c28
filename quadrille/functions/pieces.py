"""Unigram-piece tokenization: the best-scoring cut of a text into a vocabulary's pieces."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
#: Ids at the start of a vocabulary that stand for no text; 0 is the unknown piece.
RESERVED = 6


class PieceTrie:
    """Pieces by their characters; a node is a dict, and its piece's id lies under the empty string."""

    def __init__(self):
        self.root: dict = {}

    def insert(self, piece: str, id: int) -> None:
        at = self.root
        for c in piece:
            at = at.setdefault(c, {})
        at[""] = id

    def prefixes(self, text: str, start: int) -> list[tuple[int, int]]:
        """(length, id) of every piece that the text has at start; one unknown character where there is none."""
        found, at = [], self.root
        for i in range(start, len(text)):
            at = at.get(text[i])
            if at is None:
                break
            if "" in at:
                found.append((i + 1 - start, at[""]))
        return found or [(1, 0)]


class PieceTokenizer:
    """Viterbi search over the lattice of pieces. An unknown character scores 0; of equal cuts the later start wins."""

    def __init__(self, vocabulary: Sequence[tuple[str, float]], reserved: int = RESERVED):
        self.scores = [s for _, s in vocabulary]
        self.trie = PieceTrie()
        for i, (piece, _) in enumerate(vocabulary):
            if i >= reserved:
                self.trie.insert(piece, i)

    @staticmethod
    def normalize(text: str) -> str:
        text = unicodedata.normalize("NFKC", text)
        return SPACE + text.replace(" ", SPACE) if text else text

    def encode(self, text: str | None) -> list[int]:
        """Ids of the pieces; neighbouring unknowns are one. None and the empty text have none."""
        s = self.normalize(text or "")
        best = [0.0] * (len(s) + 1)  # 0 also marks a place not yet reached
        came: list[tuple[int, int]] = [(0, 0)] * (len(s) + 1)
        for i in range(len(s)):
            for n, id in self.trie.prefixes(s, i):
                score = best[i] + (self.scores[id] if id else 0.0)
                if best[i + n] == 0 or score >= best[i + n]:
                    best[i + n], came[i + n] = score, (i, id)
        out: list[int] = []
        at = len(s)
        while at > 0:
            at, id = came[at]
            if id or not out or out[-1]:
                out.append(id)
        return out[::-1]


def pieces(spark: SparkSession, text: Column, vocabulary: Sequence[tuple[str, float]], reserved: int = RESERVED) -> Column:
    """Ids of a text column's pieces. The vocabulary is broadcast once, as the fixed table that it is."""
    shared = spark.sparkContext.broadcast(list(vocabulary))
    made: list[PieceTokenizer] = []

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(PieceTokenizer(shared.value, reserved))
        return texts.map(made[0].encode)

    return encode(text)
