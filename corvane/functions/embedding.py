"""Embedding: batches through a pluggable model, and a deterministic stand-in (hashed words) where no model is at hand."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors of signed word hashes. Not a language model: equal words are near, nothing else is."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    embed.dimension, embed.most_tokens = dim, 8191
    return embed


def embedded(df: DataFrame, text_col: str, embed: Callable[[list[str]], np.ndarray], *, into: str = "embedding", batch: int = 100) -> DataFrame:
    """df with the vector of each text; the model gets `batch` texts a call, in order."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in list(np.asarray(embed(texts[i : i + batch]), np.float32))], dtype=object)

    return df.withColumn(into, run(F.col(text_col)))
