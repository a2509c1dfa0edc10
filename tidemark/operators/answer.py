"""From a question to an answer: retrieve, rerank, render, ask a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions.exprs import dynamic_topk, json_strings
from tidemark.functions.instants import with_utc_micros
from tidemark.operators.context import render
from tidemark.operators.embed import hash_embedding
from tidemark.operators.rerank import rerank, top_candidates
from tidemark.operators.search import top_for_vector

PROMPT = "Answer with the passages only and cite them as [DOC #n]. Say so if they don't hold the answer."


def filtered(store: DataFrame, environment: str | None = None, service: str | None = None, from_s: int | None = None, to_s: int | None = None, tags: list[str] | None = None) -> DataFrame:
    """The conjunction of the filters given; none keeps everything. A tag is held by the
    metadata, or by the service or environment; passages without an instant lie in no range."""
    for name, value in (("environment", environment), ("service", service)):
        if value is not None:
            store = store.where(F.col(name) == value)
    wanted = [t for t in tags or [] if t.strip()]
    if wanted:
        own = F.array_compact(F.array(F.concat(F.lit("service:"), "service"), F.concat(F.lit("env:"), "environment")))
        held = F.concat(own, json_strings(F.col("metadata"), "$.tags"))
        store = store.where(F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), held)) == 0)
    if from_s is not None:
        store = store.where(F.col("seconds") >= from_s)
    return store if to_s is None else store.where(F.col("seconds") < to_s)


def span_of(spark: SparkSession, from_utc: str | None, to_utc: str | None) -> tuple[int | None, int | None]:
    """A request's range in whole seconds, in any notation; open ends are null, reversed ones
    are turned. An end that is given but unreadable is an error."""
    ends = []
    for text in (from_utc, to_utc):
        if text is None or not text.strip():
            ends.append(None)
            continue
        us = with_utc_micros(spark.createDataFrame([(text,)], "v string"), "v", None).first()["utc_us"]
        if us is None:
            raise ValueError(f"no instant: {text}")
        ends.append(us // 1_000_000)
    a, b = ends
    return (b, a) if a is not None and b is not None and a > b else (a, b)


def ask(
    store: DataFrame, question: str, now: int, model, settings: Settings | None = None, environment: str | None = None, service: str | None = None, rewritten: str | None = None,
    from_utc: str | None = None, to_utc: str | None = None, tags: list[str] | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None,
) -> str:
    """The answer to one question over a store of chunks with vectors. The search uses the
    rewritten question if there is one, and ``embed`` if the store's vectors are a model's.
    Failures become the text of the answer, as a service would return them."""
    settings = settings or Settings()
    spark = store.sparkSession
    try:
        asked = spark.createDataFrame([(1, question, rewritten or question)], "request_id bigint, question string, searched string")
        asked = asked.select("request_id", "question", hash_embedding(F.col("searched")).alias("v"), dynamic_topk(F.col("question"), settings.topk).alias("take"))
        vector = list(asked.first()["v"]) if embed is None else embed([rewritten or question])[0]
        within = filtered(store, environment, service, *span_of(spark, from_utc, to_utc), tags)
        found = top_for_vector(within, "id", "vector", vector, settings.candidates).withColumn("request_id", F.lit(1).cast("bigint"))
        chosen = rerank(top_candidates(found, settings.candidates), asked.select("request_id", "take"), now)
        passages = chosen.join(found.drop("score"), ["request_id", "id"])
        context = render(passages, settings.excerpt_bytes).first()
        return model.chat(PROMPT, f"Question: {question}\n\n{context['context'] if context else ''}")
    except Exception as error:
        return f"The question could not be answered: {error}"
