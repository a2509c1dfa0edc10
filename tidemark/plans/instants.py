"""Queries of problem 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.instants import ABBREVIATIONS, MONTHS, is_canonical, with_utc_micros
from tidemark.sources.tables import table

_FIELDS = [
    ("rag_document", "row_id", "timestamp", "source_zone"),
    ("ask_request", "request_id", "from_utc", "client_zone"),
    ("ask_request", "request_id", "to_utc", "client_zone"),
]


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every timestamp field of both tables with its UTC instant (null: unreadable)."""
    parts = []
    for src, key, field, zone in _FIELDS:
        part = table(spark, sf_dir, src).select(
            F.lit(src).alias("src"), F.col(key).alias("row_key"), F.lit(field).alias("field"), F.col(field).alias("raw"), F.col(zone).alias("zone")
        )
        parts.append(part)
    return with_utc_micros(reduce(DataFrame.unionAll, parts), "raw", "zone")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = normalised(spark, sf_dir).where(F.col("utc_us").isNotNull() & ~is_canonical(F.col("raw")))
    return df.select("src", "row_key", "field", "utc_us")


def p1_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report per field: how many values are readable, unreadable and missing."""
    df = normalised(spark, sf_dir)
    blank = F.col("raw").isNull()
    return df.groupBy("src", "field").agg(
        F.count("*").alias("n_rows"),
        F.sum(blank.cast("long")).alias("n_null"),
        F.count("utc_us").alias("n_instants"),
        F.sum((~blank & F.col("utc_us").isNull()).cast("long")).alias("n_unreadable"),
        F.min("utc_us").alias("first_us"),
        F.max("utc_us").alias("last_us"),
    )


QUERIES = {"p1_found": p1_found, "p1_instants": p1_instants}
ORACLES: dict[str, str] = {}


def instants_sql(every: bool = False) -> str:
    """The same by SQL: one branch per notation, another way to read each of them."""
    offsets = " ".join(f"when '{k}' then {v}" for k, v in ABBREVIATIONS.items())
    months = " ".join(f"when '{m}' then {i + 1}" for i, m in enumerate(MONTHS))
    part = lambda n: f"regexp_extract(v, p, {n})"
    time = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:(\D.*))?$"
    # Pattern, then the numbers of the groups of year, month, day and of the first of the time.
    notations = [
        (r"^\s*(\d{4})-(\d{2})-(\d{2})(?:[Tt]| +)", "y|m|d"),
        (r"^\s*(\d{4})-(\d{3})()(?:[Tt]| +)", "y|j|"),
        (r"^\s*(\d{1,2})\.(\d{1,2})\.(\d{4})(?:[Tt]|,? +)", "d|m|y"),
        (r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})(?:[Tt]|,? +)", "m|d|y"),
        (r"^\s*(\d{1,2})/([A-Za-z]{3})/(\d{4})(?::| +)", "d|b|y"),
        (r"^\s*(?:[A-Za-z]{3,9}\.?,? +)?(\d{1,2})[ -]([A-Za-z]{3})[a-z]*[ -](\d{4}),? +", "d|b|y"),
        (r"^\s*(?:[A-Za-z]{3,9}\.?,? +)?([A-Za-z]{3})[a-z]* +(\d{1,2}),? +(\d{4}),? +", "b|d|y"),
        (r"^\s*(\d{4})/(\d{1,2})/(\d{1,2})(?:[Tt]| +)", "y|m|d"),
    ]
    branches = []
    for head, order in notations:
        names = order.split("|")
        cell = lambda x, names=names: part(names.index(x) + 1) if x in names else "''"
        branches.append(
            f"select src, row_key, field, zone, {cell('y')} y, {cell('m')} m, {cell('b')} b, {cell('d')} d, {cell('j')} j, {part(4)} h, {part(5)} mi, {part(6)} s, {part(7)} f, trim({part(8)}) tail "
            f"from (select *, '{head}{time}' p from raw) where regexp_matches(v, p)"
        )
    compact = r"^\s*(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?([A-Za-z]{1,5}|[+-]\d{2}(?::?\d{2})?)?\s*$"
    branches.append(
        f"select src, row_key, field, zone, {part(1)}, {part(2)}, '', {part(3)}, '', {part(4)}, {part(5)}, {part(6)}, {part(7)}, {part(8)} from (select *, '{compact}' p from raw) where regexp_matches(v, p)"
    )
    rows = " union all ".join(
        f"select '{src}' src, {key} row_key, '{field}' field, \"{field}\" v, coalesce(nullif(trim({zone}), ''), 'UTC') zone from {src}" for src, key, field, zone in _FIELDS
    )
    new = "" if every else r" and not regexp_matches(v, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$')"
    return f"""with raw as (select * from ({rows}) where v is not null{new}),
 parts as ({" union all ".join(branches)}),
 -- The marker ends at a blank or at the end; anything else that begins with these letters is a zone.
 marks as (select *, case when lower(split_part(tail, ' ', 1)) in ('am', 'a.m', 'a.m.', 'am.', 'pm', 'p.m', 'p.m.', 'pm.') then lower(tail[1]) else '' end ap from parts),
 cells as (select *, case when ap = '' then tail else trim(tail[length(split_part(tail, ' ', 1)) + 1:]) end z from marks),
 n as (select src, row_key, field, zone, z, ap, y::int y, case when b <> '' then case lower(b) {months} end else nullif(m, '')::int end m, nullif(d, '')::int d, nullif(j, '')::int j, h::int h, mi::int mi, coalesce(nullif(s, ''), '0')::int s,
   rpad(f[1:6], 6, '0')::int f from cells),
 w as (select *, case when (ap = '' and h < 24 or ap <> '' and h between 1 and 12) and mi < 60 and s < 60 then
   coalesce(try_cast(y || '-' || m || '-' || d as date), case when j between 1 and 366 and year(make_date(y, 1, 1) + (j - 1)) = y then (make_date(y, 1, 1) + (j - 1))::date end)::timestamp
   + to_hours(case when ap = '' then h else h % 12 + case when ap = 'p' then 12 else 0 end end) + to_minutes(mi) + to_seconds(s) end wall,
   regexp_extract(z, '^(?:UTC|GMT)?([+-])(\\d{{1,2}}):?(\\d{{2}})?(?:\\[[A-Za-z0-9_/+-]+\\])?$', 1) sign, regexp_extract(z, '^(?:UTC|GMT)?([+-])(\\d{{1,2}}):?(\\d{{2}})?(?:\\[[A-Za-z0-9_/+-]+\\])?$', 2) oh, regexp_extract(z, '^(?:UTC|GMT)?([+-])(\\d{{1,2}}):?(\\d{{2}})?(?:\\[[A-Za-z0-9_/+-]+\\])?$', 3) om from n),
 k as (select *, case when sign <> '' then case when sign = '-' then -1 else 1 end * (oh::int * 60 + coalesce(nullif(om, ''), '0')::int) when regexp_matches(z, '^[A-Za-z]{{1,5}}$') then case upper(z) {offsets} end end shift_min,
   case when z = '' then zone when contains(z, '/') and sign = '' then trim(z, '[]') end named from w where wall is not null),
 u as (select *, case when shift_min is not null and abs(shift_min) <= 1080 then epoch_us(wall) - shift_min * 60000000::bigint when named in (select name from pg_timezone_names()) then epoch_us(timezone(named, wall)) end us from k),
 e as (select *, case when shift_min is null and us is not null then case when timezone(named, make_timestamptz(us)) <> wall then null when timezone(named, make_timestamptz(us - 3600000000)) = wall then us - 3600000000 else us end else us end utc from u)
 select src, row_key, field, utc + f utc_us from e where utc is not null
 union all select src, row_key, field, (rpad(regexp_extract(v, '^\\s*(\\d+)', 1), 19, '0')[1:16])::bigint + coalesce(rpad(nullif(regexp_extract(v, '[.,](\\d+)', 1), '')[1:6], 6, '0'), '0')::bigint
   from raw where regexp_matches(v, '^\\s*(?:\\d{{10}}(?:[.,]\\d{{1,9}})?|\\d{{13}}|\\d{{16}}|\\d{{19}})\\s*$')"""


ORACLES["p1_found"] = instants_sql()
ORACLES["p1_instants"] = f"""with i as ({instants_sql(True)}), r as ({
    " union all ".join(f"select '{src}' src, {key} row_key, '{field}' field, \"{field}\" v from {src}" for src, key, field, _ in _FIELDS)
}) select r.src, r.field, count(*) n_rows, sum(case when v is null then 1 else 0 end)::bigint n_null, count(utc_us) n_instants, sum(case when v is not null and utc_us is null then 1 else 0 end)::bigint n_unreadable,
 min(utc_us) first_us, max(utc_us) last_us from r left join i on i.src = r.src and i.row_key = r.row_key and i.field = r.field group by r.src, r.field"""
