"""A question becomes a query plan by rules, without a model; a model is an option."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import CAUSE_WORDS, INCIDENT_WORDS, mentions

PLAN_SCHEMA = (
    "intent string, service string, environment string, monitorId string, incidentId string, metric string, sloId string, "
    "window struct<fromUtc:string,toUtc:string>, filters array<string>, missingFields array<string>, "
    "clarifyingQuestions array<string>, rewrittenQuery string"
)
SERVICE = r"\b([a-z][a-z0-9]*-(?:api|svc|service|store|sync|worker|gateway|relay|cron))\b"
ENVIRONMENT = r"(?:\benv:|\b)(prod|staging|dev)(?:uction|elopment)?\b"
_ID = r"\b{0}[ _#:-]*([0-9][0-9a-z-]*)\b"


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.lower(text), pattern, 1), F.lit(""))


_INSTANT = r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(?::\d{2})?(?:[Zz]|[+-]\d{2}:\d{2})?"
_LAST = r"\b(?:last|past)\s+(\d{1,4})?\s*(minute|hour|day|week)s?\b"


def _window(q: Column, now: Column) -> Column:
    """The range a question names: one or two written instants, the last so many minutes to
    weeks before ``now`` (seconds), or yesterday; else null."""
    iso = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    written = lambda n: F.get(F.regexp_extract_all(q, F.lit(f"({_INSTANT})"), 1), F.lit(n))
    low = F.lower(q)
    unit = F.nullif(F.regexp_extract(low, _LAST, 2), F.lit(""))
    many = F.coalesce(F.regexp_extract(low, _LAST, 1).try_cast("long"), F.lit(1))
    seconds = many * F.when(unit == "minute", 60).when(unit == "hour", 3600).when(unit == "day", 86400).otherwise(604800)
    day = F.floor(now / 86400) * 86400
    yesterday = low.rlike(r"\byesterday\b")
    start = F.when(written(0).isNotNull(), written(0)).when(unit.isNotNull(), iso(now - seconds)).when(yesterday, iso(day - 86400))
    end = F.when(written(0).isNotNull(), written(1)).when(unit.isNotNull(), iso(now)).when(yesterday, iso(day))
    return F.struct(start.alias("fromUtc"), end.alias("toUtc"))


def plan(df: DataFrame, question: str = "question", known_env: str | None = None, known_service: str | None = None, now: int | None = None) -> DataFrame:
    """Add ``plan``. Columns named in ``known_*`` beat what the text says. What is missing
    is listed with a question to ask; a null question gives an unknown plan. The window is
    read relative to ``now`` (seconds since 1970); without it only written instants count."""
    q = F.coalesce(F.col(question), F.lit(""))
    service = F.coalesce(*([F.nullif(F.col(known_service), F.lit(""))] if known_service else []), _first(q, SERVICE))
    env = F.coalesce(*([F.nullif(F.col(known_env), F.lit(""))] if known_env else []), _first(q, ENVIRONMENT))
    intent = (
        F.when(mentions(q, CAUSE_WORDS), "rootCause").when(mentions(q, INCIDENT_WORDS), "incident").when(mentions(q, ["slo", "budget"]), "slo")
        .when(mentions(q, ["monitor", "alert"]), "monitor").when(mentions(q, ["metric", "latency", "cpu", "memory"]), "metric")
        .when(mentions(q, ["log", "error"]), "logs").otherwise("unknown")
    )
    listed = lambda *pairs: F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in pairs]), lambda x: x.isNotNull())
    filters = F.filter(F.array(F.concat(F.lit("service:"), service), F.concat(F.lit("env:"), env)), lambda x: x.isNotNull())
    cells = {
        "intent": intent, "service": service, "environment": env,
        "monitorId": _first(q, _ID.format("monitor")), "incidentId": _first(q, _ID.format("(?:incident|inc)")),
        "metric": _first(q, r"\b([a-z][a-z0-9_]*(?:\.[a-z0-9_]+)+)\b"), "sloId": _first(q, _ID.format("slo")),
        "window": _window(q, F.lit(now).cast("long")),
        "filters": filters,
        "missingFields": listed((service.isNull(), "service"), (env.isNull(), "environment")),
        "clarifyingQuestions": listed((service.isNull(), "Which service do you mean?"), (env.isNull(), "Which environment: prod, staging or dev?")),
        "rewrittenQuery": F.trim(F.regexp_replace(F.regexp_replace(F.lower(q), r"\b(please|again|asap|the|a|an)\b|[()?!]", " "), r"\s+", " ")),
    }
    return df.withColumn("plan", F.struct(*[c.alias(n) for n, c in cells.items()]))


def decode_plan(json: Column) -> Column:
    """A plan from a model's JSON; null where it is none."""
    return F.from_json(json, PLAN_SCHEMA)


def plan_with_model(question: str, ask: Callable[[str], str]) -> str:
    """A model's plan as JSON text; an unknown plan if the model fails."""
    try:
        return ask(question)
    except Exception:
        return '{"intent": "unknown", "filters": [], "missingFields": [], "clarifyingQuestions": []}'
