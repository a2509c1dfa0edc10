"""Raw JSON of monitoring systems to one table of documents.

Each reader takes a column of JSON responses (landed files, one response a row) and
returns the columns of ``DOCUMENT``. A missing or wrongly typed field gives its
default; null or unreadable responses and responses without the expected array give no
rows. Filters on time and status are ordinary predicates on the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import percent_encoded, shortest_number, tag_value

DOCUMENT = ["id", "title", "text", "source_uri", "kind", "timestamp", "service", "environment", "metadata"]
# The labels in titles and texts.
QUERY, MESSAGE, SEVERITY, IMPACT, TYPE, TARGET = "\n\nQuery: ", "\n\nMessage: ", "\n\nSeverity: ", "\n\nCustomer Impact: ", "\n\nType: ", "\nTarget: "
LOG_TITLE, METRIC_TITLE, METRIC_TEXT, NO_SEVERITY = "Log: ", "Metric: ", "Active metric: ", "UNKNOWN"
BASE_URL = "https://observe.example.invalid"


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses: every file is one JSON document, in column ``payload``."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column, path: str, default: str | None = "") -> Column:
    found = F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))
    return found if default is None else F.coalesce(found, F.lit(default))


def _strings(v: Column, path: str) -> Column:
    items = F.filter(F.try_variant_get(v, path, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))


def _items(raw: DataFrame, column: str, path: str) -> DataFrame:
    parsed = raw.select(F.try_parse_json(F.col(column)).alias("v"))
    return parsed.select(F.explode(F.try_variant_get("v", path, "array<variant>")).alias("v"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())]))


def monitors(raw: DataFrame, column: str = "payload", base_url: str = BASE_URL) -> DataFrame:
    v = F.col("v")
    number = F.when(_kind(v, "$.id") == "BIGINT", F.try_variant_get(v, "$.id", "bigint"))
    df = _items(raw, column, "$").select(
        F.coalesce(number, F.lit(0)).cast("string").alias("n"), _text(v, "$.name").alias("title"), _text(v, "$.message").alias("message"),
        _text(v, "$.query").alias("query"), _text(v, "$.type").alias("monitor_type"), _strings(v, "$.tags").alias("tags"),
    )
    return df.select(
        F.concat(F.lit("monitor_"), "n").alias("id"), "title",
        F.concat("title", F.lit(QUERY), "query", F.lit(MESSAGE), "message").alias("text"),
        F.concat(F.lit(f"{base_url}/monitors/"), "n").alias("source_uri"), F.lit("monitor").alias("kind"), F.lit(None).cast("string").alias("timestamp"),
        tag_value(F.col("tags"), "service").alias("service"), tag_value(F.col("tags"), "env").alias("environment"),
        _json(monitor_type=F.col("monitor_type"), query=F.col("query"), tags=F.col("tags")).alias("metadata"),
    )


def incidents(raw: DataFrame, column: str = "payload", base_url: str = BASE_URL) -> DataFrame:
    v = F.col("v")
    df = _items(raw, column, "$.data").select(
        _text(v, "$.id").alias("n"), _text(v, "$.attributes.title").alias("title"), _text(v, "$.attributes.customer_impact_scope").alias("customer_impact"),
        _text(v, "$.attributes.severity", NO_SEVERITY).alias("severity"), _text(v, "$.attributes.created", None).alias("timestamp"),
        _text(v, "$.attributes.fields.service").alias("service"), _text(v, "$.attributes.fields.env").alias("environment"),
    )
    return df.select(
        F.concat(F.lit("incident_"), "n").alias("id"), "title",
        F.concat("title", F.lit(SEVERITY), "severity", F.lit(IMPACT), "customer_impact").alias("text"),
        F.concat(F.lit(f"{base_url}/incidents/"), "n").alias("source_uri"), F.lit("incident").alias("kind"), "timestamp", "service", "environment",
        _json(severity=F.col("severity"), customer_impact=F.col("customer_impact")).alias("metadata"),
    )


def logs(raw: DataFrame, column: str = "payload", statuses: list[str] | None = None, newest: int | None = None, base_url: str = BASE_URL) -> DataFrame:
    """``statuses``: keep only these; ``newest``: only so many by time (a page)."""
    v = F.col("v")
    df = _items(raw, column, "$.data").select(
        _text(v, "$.id").alias("n"), _text(v, "$.attributes.message").alias("text"), _text(v, "$.attributes.status").alias("status"),
        _text(v, "$.attributes.timestamp", None).alias("timestamp"), _strings(v, "$.attributes.tags").alias("tags"),
    ).withColumn("service", tag_value(F.col("tags"), "service"))
    if statuses is not None:
        df = df.where(F.col("status").isin(statuses))
    if newest is not None:
        df = df.orderBy(F.desc("timestamp"), "n").limit(newest)
    return df.select(
        F.concat(F.lit("log_"), "n").alias("id"), F.concat(F.lit(LOG_TITLE), "service", F.lit(" - "), "status").alias("title"), "text",
        F.concat(F.lit(f"{base_url}/logs?query=id:"), "n").alias("source_uri"), F.lit("logs").alias("kind"), "timestamp",
        "service", tag_value(F.col("tags"), "env").alias("environment"), _json(status=F.col("status"), tags=F.col("tags")).alias("metadata"),
    )


def dashboards(raw: DataFrame, column: str = "payload", base_url: str = BASE_URL) -> DataFrame:
    v = F.col("v")
    df = _items(raw, column, "$.dashboards").select(
        _text(v, "$.id").alias("n"), _text(v, "$.title").alias("title"), _text(v, "$.description").alias("about"),
        _text(v, "$.author_handle").alias("author"), _text(v, "$.created_at", None).alias("timestamp"),
    )
    return df.select(
        F.concat(F.lit("dashboard_"), "n").alias("id"), "title", F.when(F.col("about") == "", F.col("title")).otherwise(F.concat("title", F.lit("\n\n"), "about")).alias("text"),
        F.concat(F.lit(f"{base_url}/dashboard/"), "n").alias("source_uri"), F.lit("dashboard").alias("kind"), "timestamp",
        F.lit("").alias("service"), F.lit("").alias("environment"), _json(author=F.col("author")).alias("metadata"),
    )


def metrics(raw: DataFrame, until: str, column: str = "payload", base_url: str = BASE_URL) -> DataFrame:
    """``until``: the end of the window in which the metrics were active."""
    df = _items(raw, column, "$.metrics").select(_text(F.col("v"), "$").alias("n"))
    return df.select(
        F.concat(F.lit("metric_"), F.replace("n", F.lit("."), F.lit("_"))).alias("id"), F.concat(F.lit(METRIC_TITLE), "n").alias("title"),
        F.concat(F.lit(METRIC_TEXT), "n").alias("text"), F.concat(F.lit(f"{base_url}/metric/explorer?metric="), percent_encoded(F.col("n"))).alias("source_uri"),
        F.lit("metrics").alias("kind"), F.lit(until).alias("timestamp"), F.split_part("n", F.lit("."), F.lit(1)).alias("service"),
        F.lit("").alias("environment"), _json(metric_name=F.col("n")).alias("metadata"),
    )


def slos(raw: DataFrame, column: str = "payload", base_url: str = BASE_URL) -> DataFrame:
    v = F.col("v")
    df = _items(raw, column, "$.data").select(
        _text(v, "$.id").alias("n"), _text(v, "$.name").alias("title"), _text(v, "$.description").alias("about"), _text(v, "$.type").alias("slo_type"),
        F.coalesce(F.try_variant_get(v, "$.thresholds[0].target", "double"), F.lit(0.0)).alias("target"), _strings(v, "$.tags").alias("tags"),
    )
    head = F.when(F.col("about") == "", F.col("title")).otherwise(F.concat("title", F.lit("\n\n"), "about"))
    return df.select(
        F.concat(F.lit("slo_"), "n").alias("id"), "title",
        F.concat(head, F.lit(TYPE), "slo_type", F.lit(TARGET), shortest_number(F.col("target") * 100.0), F.lit("%")).alias("text"),
        F.concat(F.lit(f"{base_url}/slo/"), "n").alias("source_uri"), F.lit("sLO").alias("kind"), F.lit(None).cast("string").alias("timestamp"),
        tag_value(F.col("tags"), "service").alias("service"), tag_value(F.col("tags"), "env").alias("environment"),
        _json(slo_type=F.col("slo_type"), target=F.col("target"), tags=F.col("tags")).alias("metadata"),
    )


def union(*parts: DataFrame) -> DataFrame:
    """All documents, in the order of the parts."""
    return reduce(lambda a, b: a.unionByName(b), parts)
