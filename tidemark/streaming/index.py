"""Incremental indexing as a stream over landed files.

Each micro-batch is reduced to the last delivery of every document, compared with the
versions in the store, chunked, embedded and merged into the buckets of the store that it
touches. A document that is older than the stored one changes nothing, however late it
comes; one whose text is empty takes the chunks away and leaves a row that tells its
version. The checkpoint advances only after the merge, and merging a batch again changes
nothing, so a failed run is simply repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.functions.exprs import stable_id
from tidemark.operators.chunking import chunk
from tidemark.operators.embed import hash_embedding, with_provider
from tidemark.operators.store import VersionedStore, latest, payload
from tidemark.session import removed, written

Provider = Callable[[list[str]], list[list[float]]]


def points(docs: DataFrame, settings: Settings, version: str, provider: Provider | None = None) -> DataFrame:
    """Documents as points: ``point_id``, ``id``, ``chunk_of``, ``vector``, ``payload``,
    ``version``. ``provider`` embeds instead of the hashing embedder."""
    parts = chunk(docs, settings.chunk_chars, settings.chunk_overlap)
    parts = parts.withColumn("vector", hash_embedding(F.col("text"))) if provider is None else with_provider(parts, "text", provider, batch=settings.upsert_batch)
    return parts.select(stable_id(F.col("id")).alias("point_id"), "id", "chunk_of", "vector", payload().alias("payload"), F.col(version).cast("long").alias("version"))


def merge(store: VersionedStore, docs: DataFrame, settings: Settings, version: str, provider: Provider | None = None) -> None:
    """Documents into the store, the last version of each (of equal ones any, the same each time)."""
    order = [version, *(c for c in docs.columns if c not in ("id", version))]
    docs = written(latest(docs.where(F.col(version).isNotNull()), "id", *order), "index")
    fresh = docs.select(F.col("id").alias("chunk_of"), F.col(version).cast("long").alias("v"))
    old = store.read(fresh)
    if old is not None:
        had = old.groupBy("chunk_of").agg(F.max("version").alias("had"))
        fresh = fresh.join(had, "chunk_of", "left").where("had is null or v >= had").drop("had")
    fresh = written(fresh, "index")
    kept = docs.join(fresh.select(F.col("chunk_of").alias("id")), "id", "left_semi")
    rows = points(kept, settings, version, provider)
    empty = kept.where("text is null or text = ''").select(F.col("id").alias("chunk_of"), F.col(version).cast("long").alias("version"))
    rows = rows.unionByName(empty, allowMissingColumns=True)
    if old is not None:
        rows = rows.unionByName(old.join(fresh.select("chunk_of"), "chunk_of", "left_anti").select(*rows.columns))
    store.replace(rows, docs.select(F.col("id").alias("chunk_of")))
    removed(docs)
    removed(fresh)


def chunks(store: VersionedStore) -> DataFrame:
    """The chunks of a store, without the rows of emptied documents."""
    return store.read().where("point_id is not null")


def index_available(spark: SparkSession, source: str, root: str, schema, settings: Settings | None = None, version: str = "row_id", provider: Provider | None = None) -> VersionedStore:
    """Read all files that are new in ``source`` (parquet) into the store at ``root``."""
    settings = settings or Settings()
    store = VersionedStore(spark, f"{root}/points", buckets=settings.store_buckets)
    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(lambda batch, _: merge(store, batch, settings, version, provider)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return store


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 hour", lateness: str = "90 minutes") -> DataFrame:
    """Counts per window and keys; rows later than ``lateness`` are left to the batch path."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), *keys, "n"
    )
