"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.drift import changes, unify
from tidemark.sources.tables import table


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qpoint").select("id", "payload", "writer", "file_seq")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = changes(_points(spark, sf_dir), "writer", "file_seq", "id", "payload", depth=1)
    return df.select("writer", "file_seq", "change", "field", "new_field")


def p2_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes, nested fields and moves included."""
    return changes(_points(spark, sf_dir), "writer", "file_seq", "id", "payload")


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point under one set of columns."""
    return unify(_points(spark, sf_dir), "writer", "file_seq", "id", "payload", "p_").drop("payload")


QUERIES = {"p2_found": p2_found, "p2_changes": p2_changes, "p2_table": p2_table}
ORACLES: dict[str, str] = {
    "p2_found": """with v as (select writer w, file_seq f, id, payload p from qpoint where writer is not null and file_seq is not null and json_valid(payload) and json_type(payload) = 'OBJECT'),
 c as (select distinct w, f, id, k, json_type(x) t, case when json_type(x) <> 'NULL' then x::varchar end val from (select w, f, id, k, json_extract(p, '$."' || k || '"') x from (select *, unnest(json_keys(p)) k from v))),
 keys as (select w, f, k, list_sort(list_distinct(list(case when t in ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') then 'number' else t end) filter (t <> 'NULL'))) types from c group by w, f, k),
 files as (select distinct w, f from v),
 step as (select b.w, b.f from files b join files a on a.w = b.w and a.f = b.f - 1),
 gone as (select b.w, b.f, k from step b join keys a on a.w = b.w and a.f = b.f - 1 where not exists (select 1 from keys n where n.w = b.w and n.f = b.f and n.k = a.k)),
 fresh as (select b.w, b.f, k from step b join keys n on n.w = b.w and n.f = b.f where not exists (select 1 from keys a where a.w = b.w and a.f = b.f - 1 and a.k = n.k)),
 sent as (select distinct b.w, b.f, b.id from v b join v a on a.w = b.w and a.f = b.f - 1 and a.id = b.id),
 cell as (select g.w, g.f, g.k g, n.k n, s.id, x.val x, y.val y from gone g join fresh n on g.w = n.w and g.f = n.f join sent s on s.w = g.w and s.f = g.f
   left join c x on x.w = g.w and x.f = g.f - 1 and x.id = s.id and x.k = g.k left join c y on y.w = g.w and y.f = g.f and y.id = s.id and y.k = n.k),
 renamed as (select w, f, g, n from cell group by w, f, g, n having bool_and(x is not distinct from y) and bool_or(x is not null))
 select w writer, f file_seq, 'renamed' change, g field, n new_field from renamed
 union all select w, f, 'removed', k, '' from gone where not exists (select 1 from renamed r where r.w = gone.w and r.f = gone.f and r.g = gone.k)
 union all select w, f, 'added', k, '' from fresh where not exists (select 1 from renamed r where r.w = fresh.w and r.f = fresh.f and r.n = fresh.k)
 union all select b.w, b.f, 'retyped', n.k, '' from step b join keys n on n.w = b.w and n.f = b.f join keys a on a.w = b.w and a.f = b.f - 1 and a.k = n.k where n.types <> a.types and len(n.types) > 0 and len(a.types) > 0""",
}
