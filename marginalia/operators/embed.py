"""Embedding of chunks: any model behind a protocol, and a feature-hashing one that needs no model."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 8


class Embedder(Protocol):
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Unit vectors of signed word counts; equal texts get equal vectors on any machine."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]

    def embed(self, text: str) -> list[float]:
        v = [0.0] * self.dimension
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            v[h % self.dimension] += 1.0 if h >> 31 else -1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / norm for x in v]


def embedded(chunks: DataFrame, make: Callable[[], Embedder], text_col: str = "content") -> DataFrame:
    """``embedding`` beside the chunks. The model is made once a worker; texts go in slices of SLICE,
    after a failure one by one, and a text that fails alone has a null vector."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            texts, out = batch.fillna("").tolist(), []
            for low in range(0, len(texts), SLICE):
                part = texts[low : low + SLICE]
                try:
                    out += model.embed_batch(part)
                except Exception:  # noqa: BLE001  found again text by text
                    for text in part:
                        try:
                            out += model.embed_batch([text])
                        except Exception:  # noqa: BLE001
                            out.append(None)
            yield pd.Series(out)

    return chunks.withColumn("embedding", vectors(F.col(text_col)))
