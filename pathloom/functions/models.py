"""Hooks for models: an encoder of texts and a scorer of text pairs, run on Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], np.ndarray]


class HashingEncoder:
    """A stand-in for an embedding model: word hashes counted in a fixed number of places, over their length.

    It needs no model file and gives the same vector on every machine; its quality is no model's.
    """

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                out[row, h % self.dimension] += 1 if h & 0x40000000 else -1
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(lengths == 0, 1, lengths)


class OverlapScorer:
    """A stand-in for a cross-encoder: the share of words that two texts have in common."""

    def __call__(self, queries: list[str], texts: list[str]) -> np.ndarray:
        out = []
        for a, b in zip(queries, texts, strict=True):
            x, y = set((a or "").lower().split()), set((b or "").lower().split())
            out.append(len(x & y) / max(1, len(x | y)))
        return np.array(out)


def encode(df: DataFrame, text: str, out: str, encoder: Encoder, dimension: int | None = None) -> DataFrame:
    """Adds the encoder's vectors of a text column; vectors of another dimension than that asked for are an error, seen as
    they are made."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = list(encoder([t if t is not None else "" for t in texts]))
            if dimension and any(len(v) != dimension for v in found):
                raise ValueError(f"the encoder's vectors do not have {dimension} components")
            yield pd.Series(found)

    return df.withColumn(out, run(F.col(text)))


def pair_scores(scorer: Scorer, query: Column, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in batches:
            yield pd.Series(np.asarray(scorer(queries.tolist(), texts.tolist()), np.float64))

    return run(query, text)
