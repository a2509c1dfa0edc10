"""The context block of a question: its passages in order, rendered as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import allowed_metadata, excerpt, kind_name

# The labels of a block.
HEAD, TIME, SERVICE, ENV, SOURCE, SCORE, EXCERPT = "[DOC #", "Time: ", "Service: ", " | Env: ", "Source: ", "Score: ", "Excerpt:\n"


def block(place: Column, score: Column, most: int = 1500) -> Column:
    """One passage; null times, empty services and other metadata leave no line."""
    line = lambda label, c: F.coalesce(F.concat(F.lit(label), c, F.lit("\n")), F.lit(""))
    service = F.nullif(F.col("service"), F.lit(""))
    meta = F.array_join(F.transform(allowed_metadata(F.col("metadata")), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")
    return F.concat(
        F.lit(HEAD), place.cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce(kind_name(F.col("kind")), F.lit("Unknown")), F.lit(")\n"),
        line(TIME, F.col("timestamp")),
        F.coalesce(F.concat(F.lit(SERVICE), service, F.lit(ENV), F.coalesce("environment", F.lit("")), F.lit("\n")), F.lit("")),
        F.lit(SOURCE), F.coalesce("source_uri", F.lit("")), F.lit("\n"),
        F.when(score.isNotNull(), F.concat(F.lit(SCORE), F.format_string("%.3f", score), F.lit("\n"))).otherwise(""),
        F.coalesce(meta, F.lit("")), F.lit(EXCERPT), excerpt(F.coalesce("text", F.lit("")), most), F.lit("\n\n"),
    )


def render(chosen: DataFrame, most: int = 1500) -> DataFrame:
    """``request_id``, ``context``, ``n_passages``: the blocks of ``chosen`` (columns of a
    document with ``request_id``, ``place`` and ``score``) in order of ``place``."""
    rows = chosen.select("request_id", F.struct("place", block(F.col("place"), F.col("score").cast("double"), most).alias("b")).alias("x"))
    grouped = rows.groupBy("request_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return grouped.select("request_id", F.array_join(F.transform("xs", lambda x: x["b"]), "").alias("context"), F.size("xs").cast("bigint").alias("n_passages"))
