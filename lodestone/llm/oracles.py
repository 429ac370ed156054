"""DuckDB statements for the queries of this subpackage that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

STOP = """case lang
    when 'en' then 'the be to of and that have with in is was for on are as by at from or an a it this which'
    when 'de' then 'der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als'
    when 'fr' then 'de la le et les des en un du une que est pour qui dans par au sur pas plus avec'
    when 'es' then 'de la que el en y a los se las del por un para con no una su al lo' end"""

OP10 = rf"""
with b as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t, {WORDS} as ws from documents),
g as (select rid, unnest(range(1, len(ws) - 1)) as i, ws from b where len(ws) >= 3),
h as (select rid, i, count(*) over (partition by rid, ws[i], ws[i + 1], ws[i + 2]) as n from g),
rep as (select rid, count(distinct p) as n_repeat_words
        from (select rid, unnest([i, i + 1, i + 2]) as p from h where n > 1) group by rid),
ln as (select rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from b),
c as (
  select b.rid, doc_id, cast(len(ws) as bigint) as n_words,
    cast(length(array_to_string(ws, '')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
    len(ls) as n_lines,
    len(list_filter(ws, lambda w: list_contains(string_split({STOP}, ' '), lower(w)))) as n_stop,
    len(regexp_extract_all(t, '(?m)(?:\.\.\.|…)[ \t]*$')) as n_ell,
    length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) as n_cap,
    length(regexp_replace(t, '[^!?]+', '', 'g')) as n_exc
  from b join ln on b.rid = ln.rid left join rep on b.rid = rep.rid),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars::double / greatest(n_words, 1) between 2.0e0 and 12.0e0
    and n_symbols::double / greatest(n_words, 1) <= 0.10e0
    and coalesce(n_stop::double / greatest(n_words, 1) >= 0.02e0, true)
    and n_dup_lines::double / greatest(n_lines, 1) <= 0.50e0
    and n_ell::double / greatest(n_lines, 1) <= 0.50e0
    and n_cap::double / greatest(word_chars, 1) <= 0.50e0
    and n_exc::double / greatest(n_words, 1) <= 0.10e0 as kept
from f
"""

OP3 = r"""
with d as (select row_number() over () as rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as g
       from (select item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select rid, n, i, array_to_string(w[i : i + n - 1], ' ') as g
       from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hit as (select rid, dw.n, i, item from dw join bw on dw.n = bw.n and dw.g = bw.g),
pos as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from hit) group by rid),
its as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items
        from (select distinct rid, item from hit) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join pos on d.rid = pos.rid left join its on d.rid = its.rid
"""
