"""Embeddings: a provider is a function on text; one that hashes features stands in where no model is at hand."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 256
Provider = Callable[[list[str]], np.ndarray]


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a row of zeros stays."""
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def hashed(texts: list[str], width: int = WIDTH) -> np.ndarray:
    """A row for each text: words and their letter triples are hashed to a place and a sign, summed and scaled. The same
    on every machine; texts that share words are near each other."""
    out = np.zeros((len(texts), width))
    for row, text in zip(out, texts, strict=True):
        for word in re.findall(r"\w+", (text or "").lower()):
            for feature, share in [(word, 1.0), *((f"#{word[i : i + 3]}", 0.25) for i in range(len(word) - 2))]:
                h = zlib.crc32(feature.encode())
                row[h % width] += share if h >> 31 else -share
    return unit(out)


def embed(rows: DataFrame, text: str, provider: Provider = hashed) -> DataFrame:
    """rows with embedding of a text column, an Arrow batch at a time; a null text has that of an empty one."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(provider(texts.fillna("").tolist())))

    return rows.withColumn("embedding", F.pandas_udf(each, "array<double>")(F.col(text)))


def embed_picture_queries(queries: DataFrame, provider: Provider = hashed) -> DataFrame:
    """query_id and query_vec: the scaled mean of the vectors of a query and of it as a caption."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            own = texts.fillna("").tolist()
            yield pd.Series(list(unit(provider(own) + provider([f"a photo of {t}" for t in own]))))

    return queries.select("query_id", F.pandas_udf(each, "array<double>")("query").alias("query_vec"))
