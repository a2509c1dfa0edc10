"""SQL that gives the same rows as some of the queries, by the plainest way."""

from __future__ import annotations

import unicodedata

from tidemark.llm import lookalike

_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SOLID = _SPACE.replace("[", "[^", 1)

ORACLES = {
    "p3_found": f"""with d as (select distinct id, regexp_replace(lower(service), '[^\\p{{L}}\\p{{N}}]', '', 'g') s, list_distinct(list_filter(regexp_split_to_array(lower(text), '{_SPACE}+'), lambda w: w <> '')) t
   from rag_document where id is not null and service is not null and text is not null),
 c as (select * from d where s <> '' and len(t) > 0)
 select distinct a.id id_a, b.id id_b from c a join c b on a.s = b.s and a.id < b.id and len(a.t) >= 0.63 * len(b.t) and len(b.t) >= 0.63 * len(a.t)
 where len(list_intersect(a.t, b.t)) / sqrt(len(a.t)::double * len(b.t)) >= 0.8""",
    "p4_found": f"""select id, max(length(text))::bigint n_chars, max(case when len(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda w: length(w) > 1800)) > 0 then 1 else 0 end)::int forced
   from rag_document where length(text) > 1800 and id is not null group by id""",
    "p5_found": """with v as (select id, any_value(vector)::double[] v from qpoint where len(vector) = 64 and list_aggregate(list_transform(vector, lambda x: abs(x)), 'sum') > 0 group by id),
 s as (select a.id x, b.id y, list_cosine_similarity(a.v, b.v) c, row_number() over (partition by a.id order by list_cosine_similarity(a.v, b.v) desc, b.id) r from v a join v b on a.id <> b.id)
 select distinct least(x, y) id_a, greatest(x, y) id_b from s where r <= 5 and c >= 0.9""",
    "p8_found": """with size as (select source, sum(length(text))::double s from documents where doc_id is not null and source is not null and text is not null group by source),
 m as (select t.*, coalesce(s, 0) s from mix_target t left join size using (source))
 select mix_id, source from (select *, sum(s) over (partition by mix_id) whole from m) where target_share * total_ratio * whole > max_repeats * s""",
}
_WORD_SETS = ORACLES["p3_found"].partition("\n select distinct a.id id_a")[0]
ORACLES["p3_groups"] = f"""with recursive {_WORD_SETS.removeprefix('with ')},
 k as materialized (select distinct id, s, list_sort(t) t from c),
 kc as materialized (select row_number() over () n, s, t, count(*) copies from k group by s, t),
 e as materialized (select a.n x, b.n y from kc a join kc b on a.s = b.s and a.n <> b.n and len(a.t) >= 0.63 * len(b.t) and len(b.t) >= 0.63 * len(a.t) where len(list_intersect(a.t, b.t)) / sqrt(len(a.t)::double * len(b.t)) >= 0.8),
 m as materialized (select id, kc.n, copies, (select count(*) from e where e.x = kc.n) links from k join kc on k.s = kc.s and k.t = kc.t),
 step as materialized (select distinct a.id x, b.id y from m a join (select x, y from e union all select n, n from kc) e on a.n = e.x join m b on b.n = e.y),
 reach as (select id, id r from (select distinct id from m) union select reach.id, step.y from reach join step on step.x = reach.r),
 g as (select id, min(r) group_id from reach group by id)
 select id, group_id, count(*) over (partition by group_id) group_size, (select sum(links + copies - 1)::bigint from m where m.id = g.id) n_links from g"""
ORACLES["p8_targets"] = f"""with s as ({ORACLES['p8_found']}) select mix_id, source, max(target_share) target_share, (mix_id, source) in (select (mix_id, source) from s) short from mix_target group by mix_id, source"""


def _shape_sql(text: str) -> str:
    """The shape of a text by chains of ``translate`` and ``replace``: every one-to-one form
    and the ligatures (the SQL knows no other one-to-many forms)."""
    one = {chr(c): x for c, x in lookalike._NORMAL.items() if len(x) == 1 and c < 0x10000 and x != "'"}
    gone = "".join(sorted(chr(c) for c, x in lookalike._NORMAL.items() if not x and c < 0x10000))
    letters = {chr(c): x for c, x in lookalike._SHAPE.items()}
    for code in range(0x370, 0x590):
        drawn = unicodedata.normalize("NFC", unicodedata.normalize("NFD", chr(code)).translate(lookalike._SHAPE))
        if len(drawn) == 1 and drawn != chr(code):
            letters[chr(code)] = drawn
    out = f"translate({text}, '{''.join(one)}', '{''.join(one.values())}')"
    out = f"regexp_replace({out}, '[{gone}]', '', 'g')"
    for code in range(0xFB00, 0xFB07):
        out = f"replace({out}, '{chr(code)}', '{unicodedata.normalize('NFKC', chr(code))}')"
    return f"nfc_normalize(translate({out}, '{''.join(letters)}', '{''.join(letters.values())}'))"


def _words_sql(text: str) -> str:
    plain = f"regexp_replace({text}, '(?s)<!--.*?-->', ' ', 'g')"
    plain = f"regexp_replace({plain}, '</?[A-Za-z][^<>]*>|&(?:[A-Za-z][A-Za-z0-9]{{1,31}}|#[0-9]+|#[Xx][0-9A-Fa-f]+);|\\]\\([^()\\s]*\\)', ' ', 'g')"
    capitals = {chr(c): x for c, x in lookalike._CASELESS.items()}
    folded = f"translate(lower({_shape_sql(plain)}), '{''.join(capitals)}', '{''.join(capitals.values())}')"
    return f"regexp_extract_all({folded}, '[\\p{{L}}\\p{{N}}]+')"


ORACLES["p9_found"] = f"""with f as materialized (select doc_id, text, {_shape_sql('text')} s from documents where doc_id is not null and text is not null)
 select distinct a.doc_id doc_id_a, b.doc_id doc_id_b from f a join f b on a.s = b.s and a.doc_id < b.doc_id where a.text <> b.text"""
ORACLES["p9_classes"] = f"""with f as materialized (select doc_id, {_shape_sql('text')} s from documents where doc_id is not null and text is not null)
 select doc_id, min(doc_id) over (partition by s) class_id, count(*) over (partition by s) class_size from f"""
ORACLES["p7_found"] = f"""with i as materialized (select item_id, {_words_sql('text')} w from eval_item where item_id is not null and text is not null),
 g as (select item_id, least(len(w), 12) n, w, unnest(range(1, len(w) - least(len(w), 12) + 2)) k from i where len(w) > 0),
 p as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') gram from g),
 d as materialized (select doc_id, {_words_sql('text')} w from documents where doc_id is not null and text is not null),
 l as (select distinct n from p),
 h as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) k from d, l where len(w) >= n)
 select distinct doc_id, item_id from h join p on p.n = h.n and p.gram = array_to_string(h.w[h.k:h.k + h.n - 1], ' ')"""
ORACLES["p7_spans"] = ORACLES["p7_found"].partition("\n select distinct doc_id, item_id")[0] + """,
 s as materialized (select distinct doc_id, item_id, k - 1 a, k - 1 + h.n b from h join p on p.n = h.n and p.gram = array_to_string(h.w[h.k:h.k + h.n - 1], ' ')),
 e as (select *, case when a <= max(b) over (partition by doc_id order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end fresh from s),
 runs as (select *, sum(fresh) over (partition by doc_id order by a, b rows unbounded preceding) part from e),
 c as (select doc_id, count(distinct item_id) n_items from s group by doc_id)
 select runs.doc_id, min(a)::bigint word_from, max(b)::bigint word_to, any_value(n_items) n_items from runs join c on c.doc_id = runs.doc_id group by runs.doc_id, part"""
