"""Providers of what models and services give: text and embeddings.

The defaults are deterministic and offline. Others implement the same methods and are passed in.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


class EmbeddingProvider(Protocol):
    def embed(self, text: Column) -> Column:
        """A column of vectors."""
        ...


class TextProvider(Protocol):
    def expand(self, query: str) -> str:
        """A query with what might be in an answer."""
        ...

    def summary(self, text: Column) -> Column:
        """Shorter text."""
        ...


class HashEmbeddings:
    """Signed counts of hashed words, of unit length. Null and empty texts are zero vectors."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, text: Column) -> Column:
        size = self.size

        @pandas_udf("array<float>")
        def hashed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                out = []
                for codes in part:
                    codes = np.asarray(codes, dtype=np.int64) if codes is not None else np.zeros(0, np.int64)
                    vector = np.bincount(codes % size, np.where(codes // size % 2 == 0, 1.0, -1.0), size)
                    out.append((vector / (np.linalg.norm(vector) or 1.0)).astype(np.float32))
                yield pd.Series(out)

        words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+")
        return hashed(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.abs(F.xxhash64(w))))


class Extracts:
    """Text made of the text itself: queries stay as they are and a summary is a text's first sentences."""

    def __init__(self, longest: int = 200):
        self.longest = longest

    def expand(self, query: str) -> str:
        return query

    def summary(self, text: Column) -> Column:
        head = F.substring(text, 1, self.longest)
        upto = F.regexp_extract(head, r"(?s)^.*[.!?]", 0)
        return F.when(upto != "", upto).otherwise(head)
