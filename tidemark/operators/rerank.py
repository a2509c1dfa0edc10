"""Reranking of candidates: best chunk per parent, prior and recency, greedy diversity.

A candidate table has ``request_id``, ``id``, ``chunk_of``, ``score``, ``kind``, ``text``,
``seconds`` (the document's instant, may be null). Everything runs as expressions; the
greedy choice is a fold over the few candidates of a request. Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.exprs import kind_prior, recency, token_set, token_similarity

LAMBDA = 0.75


def best_per_parent(df: DataFrame) -> DataFrame:
    """The best-scored row of every parent (a whole document is its own)."""
    parent = F.coalesce("chunk_of", "id")
    order = W.partitionBy("request_id", parent).orderBy(F.desc_nulls_last("score"), "id")
    return df.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def adjusted(df: DataFrame, now: int, out: str = "adjusted") -> DataFrame:
    """Score times kind prior times recency at ``now`` (seconds since 1970)."""
    return df.withColumn(out, F.col("score").cast("double") * kind_prior(F.col("kind")) * recency(F.col("seconds"), F.lit(now)))


def top_candidates(df: DataFrame, most: int) -> DataFrame:
    """The first ``most`` candidates of every request by score."""
    order = W.partitionBy("request_id").orderBy(F.desc_nulls_last("score"), "id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _mmr(candidates: Column, take: Column) -> Column:
    """Fold: pop the head of the sorted rest, tell the others how alike they are, sort."""
    kind = "array<struct<v:double,s:double,id:string,tokens:array<string>,alike:double>>"
    empty = F.array().cast(kind)
    start = F.struct(F.array_sort(candidates).alias("rest"), empty.alias("chosen"))

    def step(state: Column, _: Column) -> Column:
        def after(p: Column) -> Column:
            others = F.transform(
                F.slice(state["rest"], 2, F.greatest(F.size(state["rest"]) - 1, F.lit(0))),
                lambda r: F.struct(r["s"].alias("s"), r["id"].alias("id"), r["tokens"].alias("tokens"), F.greatest(r["alike"], token_similarity(r["tokens"], p["tokens"])).alias("alike")),
            )
            valued = F.transform(
                others,
                lambda r: F.struct((r["s"] * LAMBDA - (1.0 - r["alike"]) * (1.0 - LAMBDA)).alias("v"), r["s"].alias("s"), r["id"].alias("id"), r["tokens"].alias("tokens"), r["alike"].alias("alike")),
            )
            return F.struct(F.array_sort(valued).alias("rest"), F.array_append(state["chosen"], p).alias("chosen"))

        # ``transform`` over the head binds it to a name.
        return F.coalesce(F.try_element_at(F.transform(F.slice(state["rest"], 1, 1), after), F.lit(1)), state)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(take, F.lit(1))), start, step, lambda s: s["chosen"])


def rerank(candidates: DataFrame, take: DataFrame, now: int, always: bool = False) -> DataFrame:
    """``request_id``, ``place``, ``id``, ``score``: the chosen hits in order. A request with
    no more candidates than it takes keeps them unchanged, ordered by rank, unless
    ``always``. ``take`` has ``request_id`` and ``take``; candidates have ``rank``."""
    counted = candidates.join(take, "request_id").withColumn("n", F.count("*").over(W.partitionBy("request_id")))
    few = F.lit(False) if always else F.col("n") <= F.col("take")
    same = counted.where(few).select("request_id", F.row_number().over(W.partitionBy("request_id").orderBy("rank")).alias("place"), "id", F.col("score").cast("double").alias("score"))
    many = adjusted(best_per_parent(counted.where(~few)), now)
    item = F.struct(
        (F.col("adjusted") * -LAMBDA - (1.0 - LAMBDA)).alias("v"), (-F.col("adjusted")).alias("s"), "id", token_set(F.coalesce("text", F.lit(""))).alias("tokens"), F.lit(0.0).alias("alike")
    )
    lists = many.where("adjusted is not null").groupBy("request_id", "take").agg(F.collect_list(item).alias("items"))
    chosen = lists.where("take > 0").select("request_id", F.posexplode(_mmr(F.col("items"), F.col("take"))).alias("p", "h"))
    picked = chosen.select("request_id", (F.col("p") + 1).alias("place"), F.col("h.id").alias("id"), (-F.col("h.s")).alias("score"))
    return same.unionByName(picked)
