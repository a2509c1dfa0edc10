"""Exact nearest-neighbour search of a set of query vectors in a vector table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors per block: a pair of blocks is one matrix product.
BLOCK = 2048
#: Queries and stored vectors of a task.
QUERY_PART, STORE_PART = 8192, 131_072


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def top_for_vector(store: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The ``k`` rows nearest to one vector: a heap per partition, no shuffle of rows."""
    score = cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return store.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), key).limit(k)


def _blocks(df: DataFrame, dim_tag: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                by_dim: dict[int, tuple[list, list]] = {}
                for i, v in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
                    norm = float(np.sqrt((x * x).sum()))
                    if np.isfinite(norm) and norm > 0:
                        ids, rows = by_dim.setdefault(len(x), ([], []))
                        ids.append(i)
                        rows.append(x / norm)
                for dim, (ids, rows) in by_dim.items():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], type=pa.int32()), pa.array([ids], type=pa.list_(pa.int64())), pa.array([np.array(rows).tobytes()], type=pa.binary())],
                        names=["dim", f"{dim_tag}_ids", f"{dim_tag}_rows"],
                    )

    return df.mapInArrow(run, f"dim int, {dim_tag}_ids array<bigint>, {dim_tag}_rows binary")


def knn(queries: DataFrame, store: DataFrame, key: str, vector: str, k: int, exclude_self: bool = False) -> DataFrame:
    """``query_id``, ``neighbour_id``, ``score``, ``rank``: exact top ``k`` for every query.
    Both sides become blocks of vectors in parts; a part of the queries meets a part of the
    store in a task of its own (the grid of both), where every pair of blocks is one matrix
    product that keeps ``k`` rows per query. So rows are never paired one by one, neither
    side is collected, and no key holds more than two parts. Unusable vectors (null, empty, zero, not finite) are left out."""
    many = lambda df, size: F.lit(max(1, -(-df.count() // size)))
    nq, ns = many(queries, QUERY_PART), many(store, STORE_PART)
    part = lambda ids, n: F.pmod(F.xxhash64(F.get(ids, F.lit(0))), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    q = _blocks(queries.select(key, vector), "q").withColumn("qp", part("q_ids", nq)).withColumn("sp", every(ns))
    s = _blocks(store.select(key, vector), "s").withColumn("sp", part("s_ids", ns)).withColumn("qp", every(nq))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a = np.frombuffer(row["q_rows"]).reshape(-1, row["dim"])
                b = np.frombuffer(row["s_rows"]).reshape(-1, row["dim"])
                qi, si = np.array(row["q_ids"]), np.array(row["s_ids"])
                score = a @ b.T
                if exclude_self:
                    score[qi[:, None] == si[None, :]] = -9.0
                # Ties at the edge go to the smaller id: sort by id first, then stably.
                order = np.argsort(si, kind="stable")
                best = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, :k]]
                value = np.take_along_axis(score, best, 1)
                keep = value > -8.0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qi, keep.sum(1))), pa.array(si[best][keep]), pa.array(value[keep])], names=["query_id", "neighbour_id", "score"]
                )

    pairs = q.join(s, ["dim", "qp", "sp"]).mapInArrow(run, "query_id bigint, neighbour_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)
