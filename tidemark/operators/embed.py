"""Embeddings. The default is a deterministic hashing embedder made of expressions; a
provider (any function from texts to vectors) runs in Arrow batches instead."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import token_set

DIM = 64


def hash_embedding(text: Column, dim: int = DIM) -> Column:
    """Signed word counts by the MD5 of each distinct word, scaled to length 1; null and
    wordless texts give zeros."""
    def bound(value: Column, body: Callable[[Column], Column]) -> Column:
        """``body`` over a value that is computed once, not wherever it is used."""
        return F.element_at(F.transform(F.array(value), body), 1)

    words = token_set(F.coalesce(text, F.lit("")))
    hashes = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"))
    sign = lambda h: F.when(F.pmod(F.shiftright(h, 16), F.lit(2)) == 0, 1).otherwise(-1)
    cell = lambda hs, i: F.aggregate(F.filter(hs, lambda h: F.pmod(h, F.lit(dim)) == i), F.lit(0), lambda s, h: s + sign(h))
    counts = bound(hashes, lambda hs: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: cell(hs, i)))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    scaled = lambda c: bound(norm(c), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))
    return bound(counts, scaled)


def with_provider(df: DataFrame, text: str, provider: Callable[[list[str]], list[list[float]]], out: str = "vector", batch: int = 64) -> DataFrame:
    """Add ``out`` by calling ``provider`` on at most ``batch`` texts at a time."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            vectors: list[list[float]] = []
            for at in range(0, len(part), batch):
                vectors += provider(["" if t is None else t for t in part.iloc[at : at + batch]])
            yield pd.Series(vectors)

    return df.withColumn(out, embed(F.col(text)))
