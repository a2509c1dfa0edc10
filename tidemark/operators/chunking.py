"""Fixed-step chunks of documents, as a generator in the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk(df: DataFrame, max_chars: int = 1800, overlap: int = 200, key: str = "id", text: str = "text") -> DataFrame:
    """Every document's chunks of at most ``max_chars`` characters, each repeating
    ``overlap`` of the one before (none if the overlap is not below the size). All columns
    are kept; ``key`` becomes ``<key>#c<n>``; ``chunk_index`` and ``chunk_of`` are added.
    Null or empty texts and ``max_chars`` of 0 give no rows."""
    if max_chars <= 0:
        return df.where(F.lit(False)).withColumns({"chunk_index": F.lit(0), "chunk_of": F.col(key)})
    step = max_chars - overlap if overlap < max_chars else max_chars
    last = F.ceil(F.greatest(F.length(text) - max_chars, F.lit(0)) / F.lit(step)).cast("int")
    out = df.where(F.length(text) > 0).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), last)))
    return out.withColumns({
        "chunk_of": F.col(key),
        text: F.substr(F.col(text), F.col("chunk_index") * step + 1, F.lit(max_chars)),
        key: F.concat(F.col(key), F.lit("#c"), F.col("chunk_index").cast("string")),
    })
