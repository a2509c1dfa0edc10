"""Scalar building blocks as Catalyst expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import TopK

# The kinds of documents, their printed names and their weights in ranking.
KINDS = {
    "logs": ("Logs", 0.98),
    "metrics": ("Metrics", 1.0),
    "monitor": ("Monitor", 1.05),
    "incident": ("Incident", 1.10),
    "dashboard": ("Dashboard", 1.0),
    "sLO": ("Slo", 1.03),
    "git": ("Git", 1.0),
}
# Fixed value: the metadata keys shown in a context block.
METADATA_KEYS = ["severity", "status", "state", "dd_incident_id", "dd_monitor_id", "dd_metric", "window_from", "window_to", "type"]
# Words of a question that widen the answer.
CAUSE_WORDS = ["why", "root cause", "rca"]
RANGE_WORDS = ["yesterday", ":", " from ", " to "]
INCIDENT_WORDS = ["incident", "sev"]
CUT_MARK = " …[truncated]"
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def _choice(key: Column, values: dict[str, object]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def kind_code(raw: Column) -> Column:
    """The kind however it is spelled; null if it is none."""
    return _choice(F.lower(F.trim(raw)), {k.lower(): k for k in KINDS})


def kind_name(kind: Column) -> Column:
    return _choice(kind, {k: v[0] for k, v in KINDS.items()})


def kind_prior(kind: Column) -> Column:
    return F.coalesce(_choice(kind, {k: v[1] for k, v in KINDS.items()}), F.lit(1.0))


def json_text(json: Column, path: str, default: str = "") -> Column:
    """The string at a path of JSON text; the default if it is absent or no string."""
    value = F.try_variant_get(F.try_parse_json(json), path, "variant")
    return F.coalesce(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.try_parse_json(json), path, "string")), F.lit(default))


def json_strings(json: Column, path: str) -> Column:
    """The strings of the array at a path of JSON text; other elements are left out."""
    items = F.try_variant_get(F.try_parse_json(json), path, "array<variant>")
    kept = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(kept, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>"))


def tag_value(tags: Column, name: str) -> Column:
    """What follows ``name:`` in the first tag that begins with it, else empty."""
    prefix = f"{name}:"
    found = F.try_element_at(F.filter(tags, lambda t: t.startswith(prefix)), F.lit(1))
    return F.coalesce(F.substring(found, len(prefix) + 1, 2_000_000_000), F.lit(""))


def percent_encoded(text: Column) -> Column:
    """Every byte but letters, digits and ``-_.~`` as %XX."""
    form = F.url_encode(text)
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def shortest_number(number: Column) -> Column:
    return F.regexp_replace(number.cast("string"), r"\.0$", "")


def stable_id(*parts: Column) -> Column:
    """32 hexadecimal digits from the parts in their order."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def rfc3339_seconds(text: Column) -> Column:
    """Whole seconds since 1970; null unless the text is a strict RFC 3339 instant."""
    plain = F.regexp_replace(F.upper(text), r"\.\d+", "")
    return F.when(text.rlike(RFC3339), F.unix_seconds(plain.try_cast("timestamp")))


def recency(seconds: Column, now: Column) -> Column:
    """Half per day of distance, at least 0.5; 1 without an instant."""
    age = F.abs(now - seconds) / F.lit(86400.0)
    return F.coalesce(F.greatest(F.lit(0.5), F.pow(F.lit(0.5), age)), F.lit(1.0))


def token_set(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""))


def token_similarity(a: Column, b: Column) -> Column:
    """Shared words over the geometric mean of both sizes (a cosine of sets)."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1.0), F.sqrt(F.size(a).cast("double") * F.size(b)))


def excerpt(text: Column, most: int = 1500) -> Column:
    """At most ``most`` bytes, cut between characters, with a mark where it was cut."""
    raw = F.encode(text, "utf-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, n).cast("string")) for n in range(most, most - 4, -1)]
    return F.when(F.octet_length(text) > most, F.concat(F.coalesce(*cuts), F.lit(CUT_MARK))).otherwise(text)


def mentions(question: Column, words: list[str]) -> Column:
    """Whether any of the words occurs, as a plain substring without case."""
    low = F.lower(question)
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w)
    return hit


def dynamic_topk(question: Column, config: TopK) -> Column:
    """How many passages a question gets; every addition is capped at the maximum."""
    if config.fixed is not None:
        return F.greatest(F.lit(1), F.least(F.lit(64), F.lit(config.fixed)))
    k = F.lit(config.default)
    for words, more in ((CAUSE_WORDS, 6), (RANGE_WORDS, 2), (INCIDENT_WORDS, 2)):
        k = F.when(mentions(question, words), F.least(k + more, F.lit(config.most))).otherwise(k)
    return k


def allowed_metadata(metadata: Column) -> Column:
    """The keys shown in a context block with their values as JSON text, sorted."""
    cells = F.try_variant_get(F.try_parse_json(metadata), "$", "map<string,variant>")
    shown = F.map_filter(cells, lambda k, v: k.isin(METADATA_KEYS))
    return F.array_sort(F.transform(F.map_entries(shown), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value"))))
