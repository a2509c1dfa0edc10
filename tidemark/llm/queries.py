"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import leaks, lookalike, mixing, near, pieces, varied, vectors
from tidemark.session import written
from tidemark.sources.tables import table

#: The domain of every source, the upper level of the mixing tree.
DOMAINS = {
    "wiki": "reference", "runbook": "reference", "changelog": "reference", "postmortem": "review", "slo_review": "review",
    "ticket": "work", "handover": "work", "oncall_diary": "work", "chat_export": "talk", "alert_note": "signal",
    "log_excerpt": "signal", "vendor_notice": "outside", "partner_feed": "outside",
}


def _services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rag_document").select("id", near.block_of(F.col("service")).alias("block"), "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.similar_pairs(_services(spark, sf_dir), "id", "block", "text")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of similar documents and its number of links."""
    return near.groups(_services(spark, sf_dir), "id", "block", "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that were cut: the sum of their pieces and whether a forced boundary was left."""
    long = table(spark, sf_dir, "rag_document").select("row_id", "id", "text").where(F.length("text") > pieces.LIMIT)
    out = pieces.split(long, "id", "text", with_text=False, also="row_id")
    one = out.groupBy("key", "row_id").agg(F.sum(F.col("core_end") - F.col("core_start")).alias("n_chars"), F.max("forced").alias("forced"))
    return one.groupBy(F.col("key").alias("id")).agg(F.max("n_chars").alias("n_chars"), F.max("forced").alias("forced"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last delivery of every document."""
    docs = table(spark, sf_dir, "rag_document").select("row_id", "id", "text", "ingested_at")
    return pieces.split(pieces.latest(docs, "id", ["ingested_at", "row_id"]), "id", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "qpoint").select("id", "vector")
    near5 = vectors.neighbours(points, "id", "vector", 5, min_score=0.9)
    return near5.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every point."""
    points = table(spark, sf_dir, "qpoint").select("id", "vector")
    return vectors.neighbours(points, "id", "vector", 5).withColumn("score", F.round("score", 4))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every hundredth point (by the hash of its id), against all points."""
    points = table(spark, sf_dir, "qpoint").select("id", "vector")
    asked = points.where(F.pmod(F.xxhash64("id"), F.lit(100)) == 0)
    out = vectors.neighbours(points, "id", "vector", 5, queries=asked)
    return out.withColumn("score", F.round("score", 4))


def p6_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, requests = table(spark, sf_dir, "hit"), table(spark, sf_dir, "ask_request").select("request_id", "take")
    return varied.select(hits, requests)


def p6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories, kinds and mean scores of every choice beside those of the best-scored hits."""
    hits, requests = table(spark, sf_dir, "hit"), table(spark, sf_dir, "ask_request").select("request_id", "take")
    return varied.quality(hits, requests)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_item")
    return leaks.leaks(docs, "doc_id", "text", items, "item_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words to remove from every leaking document, a row per span."""
    spans = leaks.removal_spans(_leaks(spark, sf_dir), "doc_id")
    return spans.select("doc_id", "n_items", F.inline("spans")).select("doc_id", F.col("a").alias("word_from"), F.col("b").alias("word_to"), "n_items")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and source is not null and text is not null")
    return written(mixing.token_counts(docs.select("doc_id", "source", F.lower("lang").alias("lang"), "text"), "text"), "sized")


def _budgets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = _sized(spark, sf_dir)
    return sized, written(mixing.plan(sized, table(spark, sf_dir, "mix_target"), DOMAINS), "budgets")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources with leaves whose budget stays below their weight."""
    parts = mixing.plan(_sized(spark, sf_dir), table(spark, sf_dir, "mix_target"), DOMAINS)
    return parts.where("unmet > 0").select("mix_id", "source").distinct()


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every mix with their repeats."""
    return mixing.choose(*_budgets(spark, sf_dir), "doc_id")


def p8_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every mix: its wanted share and whether it falls short."""
    parts = _budgets(spark, sf_dir)[1]
    return parts.groupBy("mix_id", "source").agg(F.max("target_share").alias("target_share"), (F.sum("unmet") > 0).alias("short"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares wanted and reached."""
    sized, parts = _budgets(spark, sf_dir)
    got = mixing.choose(sized, parts, "doc_id").groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("repeats"))
    rows = parts.groupBy("mix_id", "source").agg(F.max("target_share").alias("target_share"), (F.sum("unmet") > 0).alias("short"))
    out = rows.join(got, ["mix_id", "source"], "left").na.fill(0, ["tokens", "repeats"])
    whole = out.groupBy("mix_id").agg(F.sum("tokens").alias("whole"))
    share = F.when(F.col("whole") > 0, F.round(F.col("tokens") / F.col("whole"), 6)).otherwise(0.0)
    return out.join(whole, "mix_id").select("mix_id", "source", "target_share", share.alias("actual_share"), "tokens", "repeats", "short")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalike.equal_looking(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every text."""
    docs = lookalike.consistent(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return docs.select("doc_id", "form", (F.col("form") != F.col("text")).alias("changed"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of texts that look like its own."""
    out = lookalike.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.withColumnRenamed("id", "doc_id")


_ALL = [p3_found, p3_groups, p4_found, p4_pieces, p5_found, p5_nearest, p5_neighbours, p6_varied, p6_quality, p7_found, p7_spans, p8_found, p8_mix, p8_targets, p8_shares, p9_found, p9_forms, p9_classes]
QUERIES = {query.__name__: query for query in _ALL}

