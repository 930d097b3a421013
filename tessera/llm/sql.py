"""DuckDB twins that are longer than their operators' modules should carry."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = f"""
with d as (select doc_id, {_WORDS} w from documents),
b as (select item_id, {_WORDS} w from benchmark),
p as (select distinct item_id, least(len(w), 10) n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i+9], ' '))) p from b where len(w) > 0),
g as (select doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'p': array_to_string(w[i:i+n-1], ' ')}})) x from d, (select distinct n from p)),
m as (select distinct doc_id, x.i i, g.n, item_id from g join p on p.n = g.n and p.p = x.p),
h as (select doc_id, count(distinct pos) n_hit from (select doc_id, unnest(range(i, i + n)) pos from m) group by 1),
t as (select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) ids from (select distinct doc_id, item_id from m) group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h on h.doc_id = d.doc_id left join t on t.doc_id = d.doc_id"""
