"""Queries of the retrieval pipeline and their SQL, one pair per operator."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import Settings, TopK
from tidemark.functions import exprs as E
from tidemark.operators import context, requested, rerank, search, store
from tidemark.operators.chunking import chunk
from tidemark.operators.embed import hash_embedding
from tidemark.operators.planner import ENVIRONMENT, SERVICE, plan
from tidemark.plans.instants import instants_sql
from tidemark.session import shared_dir
from tidemark.sources import observability as obs
from tidemark.sources.tables import table

#: The instant that "now" means in all queries: 2026-01-01T00:00:00Z.
NOW = 1767225600
UNTIL = "2024-01-31T00:00:00Z"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- raw responses


def _svc() -> Column:
    return F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string"))


def _env() -> Column:
    return F.element_at(F.array(F.lit("prod"), F.lit("staging"), F.lit("dev")), (F.col("user_id") % 3 + 1).cast("int"))


def _eid() -> Column:
    return F.col("event_id").cast("string")


def _iso() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _tags() -> Column:
    return F.array(F.concat(F.lit("env:"), _env()), F.concat(F.lit("service:"), _svc()))


def _status() -> Column:
    return F.element_at(F.array(F.lit("error"), F.lit("warn"), F.lit("info")), (F.col("event_id") % 3 + 1).cast("int"))




def _raw(spark: SparkSession, sf_dir: str, event: str, body) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type") == event)
    return events.select(F.to_json(body).alias("payload"))


def _item(**cells) -> Column:
    return F.struct(*[c.alias(n) for n, c in cells.items()])


def _monitors(spark, sf_dir):
    one = _item(id=F.col("event_id"), name=F.concat(F.lit("user "), F.col("user_id").cast("string")), message=F.col("props"), query=F.concat(F.lit("avg:events > "), _eid()), type=F.lit("metric alert"), tags=_tags())
    return obs.monitors(_raw(spark, sf_dir, "purchase", F.array(one)))


def _incidents(spark, sf_dir):
    attrs = _item(title=F.concat(F.lit("Failure of "), _svc()), customer_impact_scope=F.lit("some"), created=_iso(), fields=_item(service=_svc(), env=_env()))
    return obs.incidents(_raw(spark, sf_dir, "error", _item(data=F.array(_item(id=_eid(), attributes=attrs)))))


def _logs(spark, sf_dir, **options):
    attrs = _item(message=F.col("props"), service=F.lit("ignored"), status=_status(), timestamp=_iso(), tags=_tags())
    return obs.logs(_raw(spark, sf_dir, "click", _item(data=F.array(_item(id=_eid(), attributes=attrs)))), **options)


def _dashboards(spark, sf_dir):
    about = F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.col("props"))
    one = _item(id=_eid(), title=F.concat(F.lit("Board "), _eid()), description=about, author_handle=_svc(), created_at=_iso())
    return obs.dashboards(_raw(spark, sf_dir, "view", _item(dashboards=F.array(one))))


def _metrics(spark, sf_dir):
    name = F.concat(F.lit("svc_"), (F.col("user_id") % 10).cast("string"), F.lit(".rate:p99."), _eid())
    return obs.metrics(_raw(spark, sf_dir, "signup", _item(metrics=F.array(name))), UNTIL)


def _slos(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    one = _item(
        id=n.cast("string"), name=F.col("p_name"), description=F.when(n % 2 == 0, F.lit("")).otherwise(F.col("p_type")), type=F.col("p_brand"),
        thresholds=F.array(_item(target=(n % 8) / 8.0)), tags=F.array(F.concat(F.lit("service:part-"), (n % 5).cast("string"))),
    )
    return obs.slos(parts.select(F.to_json(_item(data=F.array(one))).alias("payload")))


_EV = """(select *, 'svc-' || (user_id % 10) svc, ['prod','staging','dev'][(user_id % 3 + 1)::int] env, event_id::varchar eid,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') iso, ['error','warn','info'][(event_id % 3 + 1)::int] status from events)"""
_URL = obs.BASE_URL
_SQL = {
    "monitors": f"""select 'monitor_' || eid id, 'user ' || user_id title, 'user ' || user_id || chr(10) || chr(10) || 'Query: avg:events > ' || eid || chr(10) || chr(10) || 'Message: ' || props "text",
  '{_URL}/monitors/' || eid source_uri, 'monitor' kind, null::varchar "timestamp", svc service, env environment,
  '{{"monitor_type":"metric alert","query":"avg:events > ' || eid || '","tags":["env:' || env || '","service:' || svc || '"]}}' metadata from {_EV} where event_type = 'purchase'""",
    "dashboards": f"""select 'dashboard_' || eid id, 'Board ' || eid title, 'Board ' || eid || case when event_id % 2 = 0 then '' else chr(10) || chr(10) || props end "text",
  '{_URL}/dashboard/' || eid source_uri, 'dashboard' kind, iso "timestamp", '' service, '' environment, '{{"author":"' || svc || '"}}' metadata from {_EV} where event_type = 'view'""",
    "slos": f"""select 'slo_' || p_partkey id, p_name title, p_name || case when p_partkey % 2 = 0 then '' else chr(10) || chr(10) || p_type end || chr(10) || chr(10) || 'Type: ' || p_brand || chr(10) || 'Target: ' ||
  regexp_replace(((p_partkey % 8) / 8.0::double * 100)::varchar, '\\.0$', '') || '%' "text", '{_URL}/slo/' || p_partkey source_uri, 'sLO' kind, null::varchar "timestamp", 'part-' || (p_partkey % 5) service, '' environment,
  '{{"slo_type":"' || p_brand || '","tags":["service:part-' || (p_partkey % 5) || '"],"target":' || ((p_partkey % 8) / 8.0::double)::varchar || '}}' metadata from part""",
    "metrics": f"""select 'metric_svc_' || (user_id % 10) || '_rate:p99_' || eid id, 'Metric: ' || n title, 'Active metric: ' || n "text", '{_URL}/metric/explorer?metric=' || replace(n, ':', '%3A') source_uri, 'metrics' kind,
  '{UNTIL}' "timestamp", split_part(n, '.', 1) service, '' environment, '{{"metric_name":"' || n || '"}}' metadata from (select *, 'svc_' || (user_id % 10) || '.rate:p99.' || eid n from {_EV} where event_type = 'signup')""",
    "incidents": f"""select 'incident_' || eid id, 'Failure of ' || svc title, 'Failure of ' || svc || chr(10) || chr(10) || 'Severity: UNKNOWN' || chr(10) || chr(10) || 'Customer Impact: some' "text",
  '{_URL}/incidents/' || eid source_uri, 'incident' kind, iso "timestamp", svc service, env environment, '{{"customer_impact":"some","severity":"UNKNOWN"}}' metadata from {_EV} where event_type = 'error'""",
    "logs": f"""select 'log_' || eid id, 'Log: ' || svc || ' - ' || status title, props "text", '{_URL}/logs?query=id:' || eid source_uri, 'logs' kind, iso "timestamp", svc service, env environment,
  '{{"status":"' || status || '","tags":["env:' || env || '","service:' || svc || '"]}}' metadata from {_EV} where event_type = 'click'""",
}


@query(_SQL["monitors"])
def scan_monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monitors(spark, sf_dir)


@query(_SQL["incidents"])
def scan_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _incidents(spark, sf_dir)


@query(_SQL["logs"])
def scan_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logs(spark, sf_dir)


@query(f"select * from ({_SQL['logs']} and status in ('error', 'warn')) order by \"timestamp\" desc, substr(id, 5) limit 100")
def error_log_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the newest errors and warnings, as a source would return it."""
    return _logs(spark, sf_dir, statuses=["error", "warn"], newest=100)


@query(_SQL["dashboards"])
def scan_dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dashboards(spark, sf_dir)


@query(_SQL["metrics"])
def scan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir)


@query(_SQL["slos"])
def scan_slos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slos(spark, sf_dir)


@query(" union all ".join(f"({s})" for s in _SQL.values()))
def union_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six sources as one table."""
    return obs.union(*[f(spark, sf_dir) for f in (_monitors, _dashboards, _slos, _metrics, _incidents, _logs)])


@query("select kind, count(*) n from (" + " union all ".join(f"({s})" for s in _SQL.values()) + ") group by kind")
def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_corpus(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- documents and scalars

_KINDS_SQL = "case lower(trim(kind)) " + " ".join(f"when '{k.lower()}' then '{k}'" for k in E.KINDS) + " end"
_PRIOR_SQL = "case k " + " ".join(f"when '{k}' then {w}" for k, (_, w) in E.KINDS.items()) + " else 1.0 end"
_RFC = E.RFC3339.replace("\\", "\\")
_SECONDS_SQL = (
    f"case when regexp_matches(\"timestamp\", '{_RFC}') then epoch(try_cast(regexp_replace(upper(\"timestamp\"), '\\.\\d+', '') as timestamptz))::bigint end"
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "rag_document")
    return docs.withColumnRenamed("sourceUri", "source_uri").withColumn("kind", E.kind_code(F.col("kind")))


@query(f"select row_id, k kind, case k {' '.join(f'when {chr(39)}{k}{chr(39)} then {chr(39)}{n}{chr(39)}' for k, (n, _) in E.KINDS.items())} end kind_name from (select row_id, {_KINDS_SQL} k from rag_document)")
def enum_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("row_id", "kind", E.kind_name(F.col("kind")).alias("kind_name"))


@query(f"select row_id, k kind, ({_PRIOR_SQL})::double prior from (select row_id, {_KINDS_SQL} k from rag_document)")
def kind_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("row_id", "kind", E.kind_prior(F.col("kind")).alias("prior"))


@query(f"select row_id, round(coalesce(greatest(0.5, pow(0.5, abs({NOW} - s)::double / 86400)), 1.0), 6) decay, s as seconds from (select row_id, {_SECONDS_SQL} s from rag_document)")
def recency_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = E.rfc3339_seconds(F.col("timestamp"))
    return _documents(spark, sf_dir).select("row_id", seconds.alias("seconds")).withColumn("decay", F.round(E.recency(F.col("seconds"), F.lit(NOW)), 6))


_TAG_SQL = "coalesce(substr(list_filter(tags, lambda t: starts_with(t, '{0}:'))[1], {1}), '')"


@query(
    f"select row_id, {_TAG_SQL.format('service', 9)} tag_service, {_TAG_SQL.format('env', 5)} tag_env, len(tags)::bigint n_tags from (select row_id, "
    "coalesce(list_transform(list_filter(json_extract(case when json_valid(metadata) then metadata end, '$.tags')::json[], lambda t: json_type(t) = 'VARCHAR'), lambda t: t->>'$'), []) tags from rag_document)"
)
def tag_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = E.json_strings(F.col("metadata"), "$.tags")
    out = _documents(spark, sf_dir).select("row_id", tags.alias("tags"))
    return out.select("row_id", E.tag_value(F.col("tags"), "service").alias("tag_service"), E.tag_value(F.col("tags"), "env").alias("tag_env"), F.size("tags").cast("bigint").alias("n_tags"))


@query(
    "select row_id, coalesce(case when json_type(m, '$.status') = 'VARCHAR' then m->>'$.status' end, '') status, coalesce(case when json_type(m, '$.severity') = 'VARCHAR' then m->>'$.severity' end, 'UNKNOWN') severity "
    "from (select row_id, case when json_valid(metadata) then metadata end m from rag_document)"
)
def json_extract_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("metadata")
    return _documents(spark, sf_dir).select("row_id", E.json_text(m, "$.status").alias("status"), E.json_text(m, "$.severity", "UNKNOWN").alias("severity"))


_KEYS_SQL = ", ".join(f"'{k}'" for k in sorted(E.METADATA_KEYS))
_META_SQL = (
    f"list_filter(list_transform([{_KEYS_SQL}], lambda k: case when json_exists(m, '$.' || k) then k || ': ' || json_extract(m, '$.' || k)::varchar || chr(10) end), lambda x: x is not null)"
)


@query(f"select row_id, array_to_string({_META_SQL}, '') shown from (select row_id, case when json_valid(metadata) then metadata end m from rag_document) where m is not null")
def metadata_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform(E.allowed_metadata(F.col("metadata")), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")
    return _documents(spark, sf_dir).select("row_id", shown.alias("shown")).where("shown is not null")


@query("select row_id, substr(sha256(concat_ws('|', id, title)), 1, 32) stable from rag_document")
def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("row_id", E.stable_id(F.col("id"), F.col("title")).alias("stable"))


@query("select row_id, url_encode(service || ' ' || kind) encoded from rag_document")
def percent_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "rag_document")
    return docs.select("row_id", E.percent_encoded(F.concat("service", F.lit(" "), "kind")).alias("encoded"))


_EXCERPT_SQL = "case when strlen({0}) > 1500 then left({0}, list_max(list_filter(range(375, 1501), lambda n: strlen(left({0}, n)) <= 1500))) || ' …[truncated]' else {0} end"


@query(f"select row_id, {_EXCERPT_SQL.format('text')} excerpt from rag_document")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rag_document").select("row_id", E.excerpt(F.col("text")).alias("excerpt"))


# ---------------------------------------------------------------- chunks, payloads, store

_CHUNKS_SQL = (
    "select row_id, id || '#c' || i id, i::bigint chunk_index, id chunk_of, substr(text, (i * 1600 + 1)::bigint, 1800) \"text\" from "
    "(select *, unnest(range(0, 1 + ceil(greatest(length(text) - 1800, 0) / 1600.0)::bigint)) i from rag_document where length(text) > 0)"
)


@query(_CHUNKS_SQL)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "rag_document").select("row_id", "id", "text")
    return chunk(docs).select("row_id", "id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_of", "text")


@query(f"select chunk_of, count(*) n_chunks, sum(length(\"text\"))::bigint n_chars from ({_CHUNKS_SQL}) group by chunk_of")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(spark, sf_dir).groupBy("chunk_of").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


@query(
    "select p->>'$.Title' title, p->>'$.Service' service, p->>'$.Kind' kind, p->>'$.Timestamp' ts, p->>'$.id' id, json_type(p, '$.Metadata') metadata_type, row_id from "
    f"(select row_id, json_object('Title', title, 'Service', service, 'Kind', {_KINDS_SQL}, 'Timestamp', \"timestamp\", 'id', id, 'Metadata', coalesce(metadata, '{{}}')::json) p from rag_document)"
)
def payload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads written and read back field by field."""
    p = _documents(spark, sf_dir).select("row_id", store.payload().alias("p"))
    get = lambda name: F.get_json_object("p", f"$.{name}")
    kind = F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json("p"), "$.Metadata", "variant")).startswith("OBJECT"), "OBJECT")
    return p.select(
        get("Title").alias("title"), get("Service").alias("service"), get("Kind").alias("kind"), get("Timestamp").alias("ts"), get("id").alias("id"), kind.alias("metadata_type"), "row_id"
    )


@query(
    "select id, writer, file_seq, upserted_at from (select *, row_number() over (partition by id order by upserted_at desc, file_seq desc, writer desc) r from qpoint where id is not null) where r = 1"
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "qpoint").select("id", "writer", "file_seq", "upserted_at")
    return store.latest(points, "id", "upserted_at", "file_seq", "writer")


@query("select count(*) n_rows, least(count(*), 64)::bigint largest from qpoint")
def upsert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows in all batches and the largest batch (how many there are depends on the partitions)."""
    return store.batches(table(spark, sf_dir, "qpoint").select("id"), 64).agg(F.sum("n").alias("n_rows"), F.max("n").alias("largest"))


_STALE_SQL = (
    "with c as (select id, chunk_of, row_id, text from ({0})), old as (select * from c where row_id % 2 = 0), fresh as (select * from c where row_id % 2 = 1) "
    "select id, row_id from old where chunk_of not in (select chunk_of from fresh) union all select id, row_id from fresh"
)


@query(_STALE_SQL.format(_CHUNKS_SQL))
def stale_chunk_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even rows are the store and odd ones the new load; parents loaded again replace theirs."""
    c = chunk_documents(spark, sf_dir).select("id", "chunk_of", "row_id")
    return store.without_stale_chunks(c.where("row_id % 2 = 0"), c.where("row_id % 2 = 1")).select("id", "row_id")


@query(
    f"select request_id, coalesce(case when regexp_matches(trim(from_utc), '{_RFC}') then epoch(try_cast(regexp_replace(upper(trim(from_utc)), '\\.\\d+', '') as timestamptz))::bigint end, {NOW} - 5400)::bigint from_s, {NOW}::bigint to_s from ask_request"
)
def watermark_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "ask_request")
    w = store.window(F.col("from_utc"), F.lit(NOW).cast("bigint"), Settings().lookback_minutes)
    return asked.select("request_id", w.alias("w")).select("request_id", "w.from_s", "w.to_s")


@query("select event_id, ts, event_type from events where ts >= timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-20 00:00:00'")
def time_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda day: F.lit(f"2024-01-{day} 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").where((F.col("ts") >= at(10)) & (F.col("ts") < at(20))).select("event_id", "ts", "event_type")


@query("select row_id, id, service, environment from rag_document where environment = 'prod' and service = 'checkout-gateway'")
def filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "rag_document").where((F.col("environment") == "prod") & (F.col("service") == "checkout-gateway"))
    return docs.select("row_id", "id", "service", "environment")


_REQUESTED_SQL = f"""with i as materialized ({instants_sql(True)}),
 d as materialized (select id, service, environment, utc_us t, list_concat(['service:' || service, 'env:' || environment], coalesce(json_extract(case when json_valid(metadata) then metadata end, '$.tags')::varchar[], [])) tags
   from rag_document left join i on i.src = 'rag_document' and i.row_key = row_id where id is not null),
 q as (select request_id, case when trim(service) <> '' then service end service, case when trim(env) <> '' then env end env, list_filter(coalesce(filters, []), lambda f: trim(f) <> '') filters,
   trim(from_utc) <> '' has_a, trim(to_utc) <> '' has_b, x.utc_us a, y.utc_us b from ask_request
   left join i x on x.src = 'ask_request' and x.row_key = request_id and x.field = 'from_utc' left join i y on y.src = 'ask_request' and y.row_key = request_id and y.field = 'to_utc'),
 r as (select request_id, service, env, filters, coalesce(has_a, false) or coalesce(has_b, false) ranged, not (coalesce(has_a, false) and a is null or coalesce(has_b, false) and b is null) readable,
   case when a > b then b else a end a, case when a > b then a else b end b from q),
 n as (select request_id, count(distinct id) n from r join d on (r.service is null or d.service = r.service) and (r.env is null or d.environment = r.env) and list_has_all(d.tags, r.filters)
   and (not ranged or t is not null and (a is null or t >= a) and (b is null or t < b)) group by request_id)
 select request_id, case when readable then coalesce(n, 0) end n_documents from r left join n using (request_id)"""


@query(_REQUESTED_SQL)
def request_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per request by its own time range (any notation), service, environment and
    tags, each of them optional."""
    asked = table(spark, sf_dir, "ask_request").select("request_id", "service", "env", "from_utc", "to_utc", "client_zone", "filters")
    docs = table(spark, sf_dir, "rag_document").select("id", "service", "environment", "timestamp", "source_zone", "metadata")
    return requested.counts(asked, docs)


# ---------------------------------------------------------------- questions

_HAS = lambda words: "(" + " or ".join(f"contains(lower(question), '{w}')" for w in words) + ")"


@query(
    f"select request_id, coalesce({_HAS(E.CAUSE_WORDS)}, null) is_cause, {_HAS(E.RANGE_WORDS)} is_range, {_HAS(E.INCIDENT_WORDS)} is_incident from ask_request"
)
def question_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    return table(spark, sf_dir, "ask_request").select("request_id", E.mentions(q, E.CAUSE_WORDS).alias("is_cause"), E.mentions(q, E.RANGE_WORDS).alias("is_range"), E.mentions(q, E.INCIDENT_WORDS).alias("is_incident"))


@query(
    f"select request_id, (case when {_HAS(E.INCIDENT_WORDS)} then least(b + 2, 32) else b end)::bigint k from (select *, case when {_HAS(E.RANGE_WORDS)} then least(a + 2, 32) else a end b "
    f"from (select *, case when {_HAS(E.CAUSE_WORDS)} then least(16 + 6, 32) else 16 end a from ask_request))"
)
def dynamic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ask_request").select("request_id", E.dynamic_topk(F.col("question"), TopK()).cast("bigint").alias("k"))


@query(
    "select request_id, question, env, service, len(filters)::bigint n_filters, coalesce(rewritten_query, question) search_text from ask_request"
)
def request_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests written as JSON bodies and decoded again; absent fields become null."""
    body = F.to_json(F.struct("request_id", "question", "env", "service", "filters", "rewritten_query"))
    schema = "request_id bigint, question string, env string, service string, from_utc string, to_utc string, filters array<string>, rewritten_query string"
    r = table(spark, sf_dir, "ask_request").select(F.from_json(body, schema).alias("r")).select("r.*")
    n = F.when(F.col("filters").isNotNull(), F.size("filters").cast("bigint"))
    return r.select("request_id", "question", "env", "service", n.alias("n_filters"), F.coalesce("rewritten_query", "question").alias("search_text"))


_FIRST_SQL = "nullif(regexp_extract(lower(coalesce(question, '')), '{0}', 1), '')"
_INTENT_SQL = "case " + " ".join(
    f"when {_HAS(w)} then '{n}'" for n, w in (("rootCause", E.CAUSE_WORDS), ("incident", E.INCIDENT_WORDS), ("slo", ["slo", "budget"]), ("monitor", ["monitor", "alert"]), ("metric", ["metric", "latency", "cpu", "memory"]), ("logs", ["log", "error"]))
) + " else 'unknown' end"


@query(
    f"select request_id, {_INTENT_SQL} intent, coalesce(nullif(service, ''), {_FIRST_SQL.format(SERVICE)}) service, coalesce(nullif(env, ''), {_FIRST_SQL.format(ENVIRONMENT)}) environment, "
    f"array_to_string(list_filter([case when coalesce(nullif(service, ''), {_FIRST_SQL.format(SERVICE)}) is null then 'service' end, case when coalesce(nullif(env, ''), {_FIRST_SQL.format(ENVIRONMENT)}) is null then 'environment' end], lambda x: x is not null), ',') missing, "
    r"trim(regexp_replace(regexp_replace(lower(coalesce(question, '')), '\b(please|again|asap|the|a|an)\b|[()?!]', ' ', 'g'), '\s+', ' ', 'g')) rewritten from ask_request"
)
def query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of every question by rules."""
    asked = table(spark, sf_dir, "ask_request").select("request_id", "question", "env", "service")
    p = plan(asked, "question", "env", "service")
    return p.select("request_id", "plan.intent", "plan.service", "plan.environment", F.array_join("plan.missingFields", ",").alias("missing"), F.col("plan.rewrittenQuery").alias("rewritten"))


# ---------------------------------------------------------------- search and ranking

_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TOKENS_SQL = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '" + _SPACE.replace("{", "{{").replace("}", "}}") + "'), lambda w: w <> ''))"


@query(
    f"with t as (select request_id, list_transform({_TOKENS_SQL.format("coalesce(question, '')")}, lambda w: ('0x' || substr(md5(w), 1, 8))::bigint) h from ask_request), "
    "c as (select request_id, unnest(range(0, 64)) cell, h from t), n as (select request_id, cell::int cell, coalesce(list_sum(list_transform(list_filter(h, lambda x: x % 64 = cell), lambda x: case when (x >> 16) % 2 = 0 then 1 else -1 end)), 0)::double v from c) "
    "select request_id, cell, round(v / sqrt(sum(v * v) over (partition by request_id)), 5) amount from n qualify v <> 0"
)
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of every question's embedding that aren't zero."""
    v = table(spark, sf_dir, "ask_request").select("request_id", F.posexplode(hash_embedding(F.col("question"))).alias("cell", "x"))
    return v.where("x <> 0").select("request_id", "cell", F.round(F.col("x").cast("double"), 5).alias("amount"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


@query(
    "select vec_id, label, round(list_cosine_similarity(embedding, (select embedding from embeddings where vec_id = 0))::double, 4) score from embeddings order by list_cosine_similarity(embedding, (select embedding from embeddings where vec_id = 0)) desc, vec_id limit 64"
)
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 vectors nearest to one."""
    query_vector = list(_vectors(spark, sf_dir).where("vec_id = 0").first()["embedding"])
    top = search.top_for_vector(_vectors(spark, sf_dir), "vec_id", "embedding", query_vector, 64)
    return top.select("vec_id", "label", F.round("score", 4).alias("score"))


@query(
    "select vec_id, label, round(list_cosine_similarity(embedding, (select embedding from embeddings where vec_id = 0))::double, 4) score from embeddings where label = 3 order by list_cosine_similarity(embedding, (select embedding from embeddings where vec_id = 0)) desc, vec_id limit 64"
)
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    query_vector = list(_vectors(spark, sf_dir).where("vec_id = 0").first()["embedding"])
    top = search.top_for_vector(_vectors(spark, sf_dir).where("label = 3"), "vec_id", "embedding", query_vector, 64)
    return top.select("vec_id", "label", F.round("score", 4).alias("score"))


_BATCH_SQL = (
    "select query_id, neighbour_id, round(s, 4) score, r::bigint rank from (select q.vec_id query_id, e.vec_id neighbour_id, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) s, "
    "row_number() over (partition by q.vec_id order by list_cosine_similarity(q.embedding::double[], e.embedding::double[]) desc, e.vec_id) r from embeddings q, embeddings e where q.vec_id % 100 = 0 and q.vec_id <> e.vec_id) where r <= {0}"
)


@query(_BATCH_SQL.format(10))
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector, against all."""
    v = _vectors(spark, sf_dir)
    out = search.knn(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 10, exclude_self=True)
    return out.select("query_id", "neighbour_id", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hits with the instant of their document."""
    hits = table(spark, sf_dir, "hit").where("request_id is not null and id is not null").withColumn("kind", E.kind_code(F.col("kind")))
    hits = store.latest(hits.withColumn("key", F.struct("request_id", "id")), "key", "score", "text", "kind", "chunk_of", "service").drop("key")
    docs = table(spark, sf_dir, "rag_document").select(F.col("id").alias("parent"), "row_id", E.rfc3339_seconds(F.col("timestamp")).alias("seconds"))
    docs = store.latest(docs, "parent", "row_id").drop("row_id")
    return hits.withColumn("parent", F.coalesce("chunk_of", "id")).join(docs, "parent", "left")


_HITS_SQL = f"""h as (select h.*, d.seconds as seconds from (select request_id, id, chunk_of, score, {_KINDS_SQL} kind, text, service,
   row_number() over (partition by request_id, id order by score desc nulls last, text desc nulls last, {_KINDS_SQL} desc nulls last, chunk_of desc nulls last, service desc nulls last) r from hit where request_id is not null and id is not null) h
  left join (select id, {_SECONDS_SQL} as seconds, row_number() over (partition by id order by row_id desc) r from rag_document) d on d.id = coalesce(h.chunk_of, h.id) and d.r = 1 where h.r = 1)"""
_ADJ_SQL = f"score::double * ({_PRIOR_SQL.replace('case k', 'case kind')})::double * coalesce(greatest(0.5::double, pow(0.5::double, abs({NOW} - seconds)::double / 86400)), 1.0::double)"


@query(f"with {_HITS_SQL} select request_id, id, round({_ADJ_SQL}, 6) adjusted from h")
def adjusted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.adjusted(_hits(spark, sf_dir), NOW).select("request_id", "id", F.round("adjusted", 6).alias("adjusted"))


@query(f"with {_HITS_SQL} select request_id, id, score from (select *, row_number() over (partition by request_id, coalesce(chunk_of, id) order by score desc nulls last, id) b from h) where b = 1")
def parent_best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.best_per_parent(_hits(spark, sf_dir)).select("request_id", "id", "score")


_SIM_SQL = "len(list_intersect({0}, {1})) / greatest(1.0::double, sqrt(len({0})::double * len({1})))"


@query(
    f"with {_HITS_SQL}, t as (select h.request_id, id, {_TOKENS_SQL.format('h.text')} a, {_TOKENS_SQL.format('q.question')} b from h join ask_request q on q.request_id = h.request_id) select request_id, id, round({_SIM_SQL.format('a', 'b')}, 6) similarity from t"
)
def token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit's text against its question."""
    asked = table(spark, sf_dir, "ask_request").select("request_id", "question")
    pairs = _hits(spark, sf_dir).join(asked, "request_id")
    similarity = E.token_similarity(E.token_set(F.col("text")), E.token_set(F.col("question")))
    return pairs.select("request_id", "id", F.round(similarity, 6).alias("similarity"))


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    take = table(spark, sf_dir, "ask_request").select("request_id", "take")
    return rerank.top_candidates(_hits(spark, sf_dir), 64), take


_TOP_SQL = f"""{_HITS_SQL}, top as (select * from (select *, row_number() over (partition by request_id order by score desc nulls last, id) rank from h) where rank <= 64),
 c as (select t.*, q.take, count(*) over (partition by t.request_id) n from top t join ask_request q on q.request_id = t.request_id)"""
_SAME_SQL = "select request_id, row_number() over (partition by request_id order by rank)::bigint place, id, round(score::double, 6) score from c where n <= take"
_MMR_SQL = f"""with recursive {_TOP_SQL}, m as (select request_id, id, {_ADJ_SQL} s, take, {_TOKENS_SQL.format("coalesce(text, '')")} t from
   (select *, row_number() over (partition by request_id, coalesce(chunk_of, id) order by score desc nulls last, id) b from c where n > take) where b = 1 and score is not null),
 sims as (select a.request_id, a.id a, b.id b, {_SIM_SQL.format('a.t', 'b.t')} sim from m a join m b on a.request_id = b.request_id and a.id <> b.id),
 r as (select request_id, 1 place, id, s, 0.0::double alike, take, first_value(id) over (partition by request_id order by 0.75::double * s + 0.25::double desc, s desc, id) picked from m
  union all
  select request_id, place + 1, id, s, alike, take, first_value(id) over (partition by request_id order by 0.75::double * s + 0.25::double * (1 - alike) desc, s desc, id) picked
  from (select r.request_id, r.place, r.id, r.s, greatest(r.alike, x.sim) alike, r.take from r join sims x on x.request_id = r.request_id and x.a = r.id and x.b = r.picked where r.id <> r.picked and r.place < r.take))
 select request_id, place::bigint place, id, round(s, 6) score from r where id = picked union all ({_SAME_SQL})"""


@query(_MMR_SQL)
def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: best chunk per parent, prior, recency, greedy diversity, per request."""
    out = rerank.rerank(*_ranked(spark, sf_dir), NOW)
    return out.select("request_id", F.col("place").cast("bigint").alias("place"), "id", F.round("score", 6).alias("score"))


_T1_SQL = f"""c as (select n.query_id request_id, neighbour_id::varchar id, null::varchar chunk_of, n.score, rank, 16 take, count(*) over (partition by query_id) n, {_KINDS_SQL} kind, text, {_SECONDS_SQL} as seconds
   from ({_BATCH_SQL.format(64)}) n join rag_document d on d.row_id = n.neighbour_id)"""


@query(f"with recursive {_T1_SQL}, m as (" + _MMR_SQL.split(", m as (", 1)[1].replace(", 6)", ", 9)"))
def two_phase_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 nearest of every hundredth vector, then the rerank to 16: a vector stands for
    the document with its number."""
    v = _vectors(spark, sf_dir)
    near = search.knn(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 64, exclude_self=True)
    docs = _documents(spark, sf_dir).select(F.col("row_id").alias("neighbour_id"), "kind", "text", E.rfc3339_seconds(F.col("timestamp")).alias("seconds"))
    found = near.join(docs, "neighbour_id").select(
        F.col("query_id").alias("request_id"), F.col("neighbour_id").cast("string").alias("id"), F.lit(None).cast("string").alias("chunk_of"), F.round("score", 4).alias("score"), "kind", "text", "seconds", "rank"
    )
    out = rerank.rerank(found, found.select("request_id", F.lit(16).alias("take")).distinct(), NOW)
    return out.select("request_id", F.col("place").cast("bigint").alias("place"), "id", F.round("score", 9).alias("score"))


@query(f"with {_TOP_SQL} {_SAME_SQL}")
def mmr_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with no more candidates than they take keep them as they are."""
    hits, take = _ranked(spark, sf_dir)
    small = hits.join(take, "request_id").withColumn("n", F.count("*").over(W.partitionBy("request_id"))).where("n <= take")
    out = rerank.rerank(small.select(*hits.columns), take, NOW)
    return out.select("request_id", F.col("place").cast("bigint").alias("place"), "id", F.round("score", 6).alias("score"))


_NAME_SQL = "case kind " + " ".join(f"when '{k}' then '{n}'" for k, (n, _) in E.KINDS.items()) + " else 'Unknown' end"
_BLOCK_SQL = (
    f"'[DOC #' || rank || '] ' || coalesce(title, '') || ' (' || {_NAME_SQL} || ')' || chr(10) || coalesce('Time: ' || ts || chr(10), '') || coalesce('Service: ' || nullif(service, '') || ' | Env: ' || coalesce(environment, '') || chr(10), '') || "
    f"'Source: ' || coalesce(uri, '') || chr(10) || coalesce('Score: ' || printf('%.3f', floor(score::double * 1000 + 0.5) / 1000) || chr(10), '') || coalesce(array_to_string({_META_SQL}, ''), '') || 'Excerpt:' || chr(10) || {_EXCERPT_SQL.format('body')} || chr(10) || chr(10)"
)


@query(
    f"with {_TOP_SQL}, d as (select id, title, \"timestamp\" ts, environment, sourceUri uri, case when json_valid(metadata) then metadata end m, row_number() over (partition by id order by row_id desc) r from rag_document), "
    f"x as (select c.request_id, c.rank, c.kind, c.service, c.score, coalesce(c.text, '') body, d.title, d.ts, d.environment, d.uri, d.m from c left join d on d.id = coalesce(c.chunk_of, c.id) and d.r = 1 where c.rank <= c.take) "
    f"select request_id, string_agg({_BLOCK_SQL}, '' order by rank) context, count(*) n_passages from x group by request_id"
)
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of every request by score, rendered as one text."""
    hits, take = _ranked(spark, sf_dir)
    docs = table(spark, sf_dir, "rag_document").select(F.col("id").alias("parent"), "row_id", "title", "timestamp", "environment", F.col("sourceUri").alias("source_uri"), "metadata")
    docs = store.latest(docs, "parent", "row_id").drop("row_id")
    chosen = hits.join(take, "request_id").where("rank <= take").join(docs, "parent", "left").withColumnRenamed("rank", "place")
    return context.render(chosen)


# ---------------------------------------------------------------- incremental


@query(
    "with a as (select id, row_id v, text from rag_document union all select id, row_id + 1000000000, '' from rag_document where row_id % 10 = 0), d as (select *, row_number() over (partition by id order by v desc) r from a where id is not null) "
    "select id || '#c' || unnest(range(0, 1 + ceil(greatest(length(text) - 1800, 0) / 1600.0)::bigint)) id, id chunk_of, v::bigint version from d where r = 1 and length(text) > 0"
)
def streaming_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the stream into an empty store, in three batches: the odd rows,
    the even rows (many of them older than what is stored), and some documents emptied."""
    from tidemark.streaming.index import chunks, index_available

    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "rag_document").withColumnRenamed("sourceUri", "source_uri").withColumn("version", F.col("row_id"))
    emptied = source.where("row_id % 10 = 0").withColumns({"text": F.lit(""), "version": F.col("row_id") + 1_000_000_000})
    for landing in (source.where("row_id % 2 = 1"), source.where("row_id % 2 = 0"), emptied):
        landing.write.mode("append").parquet(f"{root}/landed")
        store = index_available(spark, f"{root}/landed", root, source.schema, version="version")
    return chunks(store).select("id", "chunk_of", "version")
