"""DuckDB statements for the catalogue, composed from the same layers as the plans they check."""

from __future__ import annotations

from lodestone.functions.lexical import RANK_STOPWORDS, STOPWORDS

NL = "chr(10)"


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w not in {_list(STOPWORDS)})"


def norm(t: str) -> str:
    return f"case when length({t}) > 3 and lower({t}) like '%s' then substr(lower({t}), 1, length({t}) - 1) else lower({t}) end"


def rank_terms(x: str, stop: bool = False) -> str:
    found = f"list_filter(regexp_extract_all({x}, '[A-Za-z0-9_/-]+'), lambda t: length(t) > 1)"
    parts = f"flatten(list_transform({found}, lambda t: list_concat([t], list_filter(string_split_regex(t, '[/_-]+'), lambda p: length(p) > 1))))"
    out = f"list_distinct(list_transform({parts}, lambda t: {norm('t')}))"
    return f"list_filter({out}, lambda t: t not in {_list(RANK_STOPWORDS)})" if stop else out


def query_terms(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[A-Za-z0-9_/-]+'), lambda t: length(t) > 1)"


def both(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def compact(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g')"


def trim_boundary(x: str, limit: int) -> str:
    c = compact(x)
    at = f"length(regexp_extract(substr({c}, 1, {limit}), '(?s)^(.*) ', 1))"
    cut = f"substr(substr({c}, 1, {limit}), 1, case when {at} > 0 then {at} else {limit} end)"
    return rf"case when length({c}) <= {limit} then {c} else regexp_replace({cut}, '[\s\p{{Z}}]+$', '') || '...' end"


KB = f"""
kb as (
  select *, '# ' || title || {NL} || {NL} || body as content,
    folder || '/' || case when doc_id % 50 = 0 then 'g' || doc_id || '/index' else 'd' || doc_id end || extension as path
  from (select doc_id, coalesce(lang, 'none') as collection, source as folder, coalesce(text, '') as body,
          trim(substr(split_part(coalesce(text, ''), {NL}, 1), 1, 60)) as title,
          case lang when 'en' then '.md' when 'fr' then '.py' when 'de' then '.sql' else '.yaml' end as extension,
          cast(1704067200 + doc_id * 3600 as double) as mtime,
          case when doc_id % 17 = 0 then 'superseded' end as status,
          coalesce(case when doc_id % 5 = 0 then trim(substr(split_part(coalesce(text, ''), {NL}, 2), 1, 40)) end, '') as also
        from documents) b),
docs as (
  select doc_id, collection, path, folder, extension, mtime, content, status, t as title,
    case when lower(also) <> lower(t) then also else '' end as aliases
  from (select *, case when extension = '.md'
          then coalesce(nullif({strip("regexp_extract(content, '(?m)^#[[:space:]]+(.+)$', 1)")}, ''), regexp_replace(list_last(string_split(path, '/')), '[.][^.]+$', ''))
          else list_last(string_split(path, '/')) end as t from kb) k)"""

CHUNKS = KB + f""",
cut as (
  select *, case when length(content) <= 1500 then 1 else cast(ceil(length(content) / 1400.0) as integer) end as chunk_count from docs),
raw as (
  select * exclude (i), cast(i as integer) as chunk_index, substr(content, cast(i as integer) * 1400 + 1, 1500) as piece
  from (select *, unnest(range(chunk_count)) as i from cut) u),
heads as (
  select *, list_transform(list_filter(list_transform(string_split_regex(piece, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {strip('x')}),
    lambda x: regexp_matches(x, '^#{{1,6}}\\s+.+$')), lambda x: {strip("regexp_replace(x, '^#{1,6}[[:space:]]+', '')")}) as hs
  from raw),
ch as (
  select * exclude (hs), case when len(hs) > 0 then array_to_string(hs[-3:], ' > ') else title end as breadcrumb,
    regexp_replace('Document: ' || title || {NL} || 'Folder: ' || folder || {NL} || {NL}
      || case when chunk_index = 0 and aliases <> '' then 'Also known as: ' || aliases || {NL} || {NL} else '' end || piece, '[\\s\\p{{Z}}]+$', '') as text
  from heads)"""

POSTINGS = CHUNKS + f""",
tok as (select collection, path, chunk_index, unnest({words('text')}) as term from ch),
tf as (select collection, path, chunk_index, term, count(*) as tf from tok group by all),
dl as (select collection, path, chunk_index, cast(sum(tf) as bigint) as dl from tf group by all),
post as (select tf.*, dl.dl from tf join dl using (collection, path, chunk_index)),
tdf as (select collection, term, count(*) as df from tf group by all),
st as (select c.collection, c.n, coalesce(t.total, 0) / c.n as avgdl
       from (select collection, count(*) as n from ch group by all) c
       left join (select collection, cast(sum(dl) as double) as total from dl group by all) t using (collection))"""

QUERIES = """
q as (select cast(item_id as bigint) as qid, text as query from benchmark)"""

SCORED = POSTINGS + "," + QUERIES + f""",
qw as (select qid, term, count(*) as times from (select qid, unnest({words('query')}) as term from q) x group by all),
w as (select qid, tdf.collection, term, avgdl, times * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) as weight from qw join tdf using (term) join st using (collection)),
sc as (select qid, collection, path, chunk_index, round(sum(weight * cast(tf as double) / (cast(tf as double) + 1.2e0 * (1 - 0.5e0 + 0.5e0 * dl / avgdl))), 9) as score
       from post join w using (collection, term) group by all),
qt as (select qid, {rank_terms('query', True)} as q from q)"""


def keyword(n: int, tag: str = "", where: str = "true", filtered: bool = False) -> str:
    """CTEs pool, an, dr and kw (with a tag) of a keyword search for n documents."""
    size = min(max(n * 25, 200), 500)
    meta = f"list_distinct({rank_terms('title')} || {rank_terms('path')} || {rank_terms('breadcrumb')} || {rank_terms('folder')} || {rank_terms('aliases')})"
    names = f"list_filter(list_transform(list_concat([title], string_split(aliases, ';')), lambda x: {rank_terms('x', True)}), lambda x: len(x) > 0)"
    keep = "" if filtered else "where score >= greatest(1.0e0, 0.72e0 * ln(greatest(n, 2))) or overlap >= 0.20e0 or covers_query"
    return f""",
pool{tag} as (select * from (select sc.*, row_number() over (partition by qid, collection order by score desc, path, chunk_index) as pool_rank
        from sc {"semi join (select collection, path, chunk_index from ch where " + where + ") f using (collection, path, chunk_index)" if filtered else ""}
        where score > 0) x where pool_rank <= {size}),
an{tag} as (
  select qid, collection, path, chunk_index, score, pool_rank, status, title, q,
    case when len(q) = 0 then 0.0e0 else {both('q', 'meta')}::double / len(q) end as overlap,
    len(q) > 0 and len(list_filter(names, lambda x: {both('q', 'x')} = len(q) and len(q)::double / len(x) >= 0.6e0)) > 0 as names_query,
    len(q) > 0 and {both('q', 'tt')} = len(q) as covers_query
  from (select p.*, c.status, c.title, qt.q, {meta} as meta, {names} as names, {rank_terms('text')} as tt
        from pool{tag} p join ch c using (collection, path, chunk_index) join qt using (qid)) y),
dg{tag} as (
  select qid, collection, path, min(pool_rank) as pool_rank, arg_min(chunk_index, pool_rank) as chunk_index, arg_min(score, pool_rank) as chunk_score,
    arg_min(names_query, pool_rank) as names_query, any_value(status) as status, max(overlap) as overlap, bool_or(covers_query) as covers_query,
    list(score order by score desc, pool_rank) as scores, count(*) as support
  from an{tag} group by qid, collection, path),
ds{tag} as (
  select *, list_reduce(list_concat([0.0e0], list_transform(scores[2:4], lambda s: s / chunk_score)), lambda a, s: a + s) as ratio from dg{tag}),
db{tag} as (
  select *, chunk_score + 0.3e0 * chunk_score * (ratio / (1.0e0 + ratio)) + chunk_score * least(1.5e0, 4.0e0 * overlap) as base from ds{tag}),
dr{tag} as (
  select qid, collection, path, pool_rank, chunk_index, chunk_score, support, overlap, covers_query, names_query,
    round(case when names_query then base + chunk_score * 3.0e0
      when lower(list_last(string_split(path, '/'))) in ('index.md', 'log.md', 'changelog.md') then base * 0.4e0 else base end
      * case when status in ('superseded', 'deprecated') then 0.7e0 else 1.0e0 end + 2e-11, 9) as score
  from db{tag}),
kw{tag} as (select * from (select dr{tag}.*, row_number() over (partition by qid, collection order by score desc, pool_rank) as rank
        from dr{tag} join st using (collection) {keep}) z where rank <= {n})"""


def _buckets(src: str, keys: str, text: str) -> str:
    return f"""select {keys}, ('0x' || substr(md5(w), 1, 2))::integer % 64 as d, count(*)::double as v
      from (select {keys}, unnest({words(text)}) as w from {src}) x group by all"""


SEMANTIC = f""",
cv as ({_buckets('ch', 'collection, path, chunk_index', 'text')}),
qv as ({_buckets('q', 'qid', 'query')}),
cn as (select collection, path, chunk_index, sqrt(sum(v * v)) as norm from cv group by all),
qn as (select qid, sqrt(sum(v * v)) as norm from qv group by all),
dots as (select qid, collection, path, chunk_index, sum(cv.v * qv.v) / any_value(cn.norm) / any_value(qn.norm) as cosine
         from cv join qv using (d) join cn using (collection, path, chunk_index) join qn using (qid) group by qid, collection, path, chunk_index),
co as (select q.qid, ch.collection, ch.path, ch.chunk_index, round(coalesce(cosine, 0.0e0), 9) as cosine
       from q cross join ch left join dots using (qid, collection, path, chunk_index))"""


def semantic(k: int, tag: str = "") -> str:
    names = f"list_filter(list_transform(list_concat([title], string_split(aliases, ';')), lambda x: {rank_terms('x', True)}), lambda x: len(x) > 0)"

    def share(x: str) -> str:
        return f"({both('q', x)}::double / len(q))"

    name = f"case when {both('q', 'x')} = len(q) and len(x) = len(q) then 0.20e0 when {both('q', 'x')} = len(q) then 0.08e0 else 0.04e0 * {share('x')} end"
    content = f"case when len(q) = 1 then least(0.02e0, 0.02e0 * {share('tt')}) else least(0.18e0, 0.22e0 * {share('tt')}) end"
    return f""",
sp{tag} as (select * from (select co.*, row_number() over (partition by qid, collection order by cosine desc, path, chunk_index) as pool_rank from co) x
            where pool_rank <= {max(k, 50)}),
sb{tag} as (
  select qid, collection, path, chunk_index, cosine, pool_rank, status,
    case when len(q) = 0 then 0.0e0 else round(least(0.30e0, coalesce(list_max(list_transform(names, lambda x: {name})), 0.0e0)
      + case when len(pt) > 0 then 0.04e0 * {share('pt')} else 0.0e0 end + case when len(tt) > 0 then {content} else 0.0e0 end) + 2e-11, 9) end as boost
  from (select p.*, c.status, qt.q, {names} as names, {rank_terms('path')} as pt, {rank_terms('text')} as tt
        from sp{tag} p join ch c using (collection, path, chunk_index) join qt using (qid)) y),
ss{tag} as (select *, round((cosine + boost) * case when status in ('superseded', 'deprecated') then 0.7e0 else 1.0e0 end + 2e-11, 9) as sort_score from sb{tag}),
sm{tag} as (select * from (select ss{tag}.*, row_number() over (partition by qid, collection order by sort_score desc, pool_rank) as rank from ss{tag}) z where rank <= {k})"""


def _ranks(src: str, out: str, score: str) -> str:
    return f"""{out} as (select *, row_number() over (partition by qid, collection order by rank) as doc_rank
  from (select qid, collection, path, chunk_index, rank, {score} as score, row_number() over (partition by qid, collection, path order by rank) as nth from {src}) x where nth = 1)"""


def hybrid(k: int, tag: str = "") -> str:
    """CTE hy (with a tag); keyword and semantic CTEs of depth 2k and 4k carry the tag h."""
    return (
        keyword(2 * k, "h")
        + semantic(4 * k, "h")
        + f""",
{_ranks('kwh', 'ka', 'score')},
{_ranks('smh', 'sa', 'cosine')},
hy{tag} as (select * from (select *, row_number() over (partition by qid, collection order by rrf desc, kr nulls last, sr) as rank from (
    select coalesce(ka.qid, sa.qid) as qid, coalesce(ka.collection, sa.collection) as collection, coalesce(ka.path, sa.path) as path,
      coalesce(ka.chunk_index, sa.chunk_index) as chunk_index, coalesce(ka.score, sa.score) as score, ka.doc_rank as kr, sa.doc_rank as sr,
      round(coalesce(0.6e0 / (60 + ka.doc_rank), 0.0e0) + coalesce(0.4e0 / (60 + sa.doc_rank), 0.0e0), 12) as rrf
    from ka full join sa on ka.qid = sa.qid and ka.collection = sa.collection and ka.path = sa.path) f) g where rank <= {k})"""
    )


def keywordish(x: str) -> str:
    found = f"regexp_extract_all(lower({x}), '[A-Za-z0-9_/-]+')"
    return rf"""case when len({found}) = 0 then false else
      coalesce(len({found}) <= 4 and ({found})[1] = 'what' and ({found})[2] in ('is', 'are'), false)
      or len(list_filter({found}, lambda w: regexp_matches(w, '[_/-]') or regexp_matches(w, '[0-9]'))) > 0
      or len(list_filter(string_split_regex({x}, '[\s\p{{Z}}]+'), lambda w: length(w) > 1 and regexp_matches(w, '\p{{Lu}}') and not regexp_matches(w, '\p{{Ll}}'))) > 0
      or (len({found}) <= 6 and len(list_filter({found}, lambda w: w in {_list(RANK_STOPWORDS)})) = 0) end"""


ROUTES = f""",
mg as (select qid, collection, count(*) as hits, max(case when rank = 1 then score end) as best, max(case when rank = 2 then score end) as second from kw group by all),
rr as (
  select q.qid, st.collection, coalesce(hits, 0) as hits, case when second > 0 then best / second when second is not null then 'infinity'::double end as margin,
    {keywordish('q.query')} as kwish, hy.score as top
  from q cross join st left join mg on mg.qid = q.qid and mg.collection = st.collection
  left join hy on hy.qid = q.qid and hy.collection = st.collection and hy.rank = 1),
rt as (
  select qid, collection, hits, margin, (hits = 0 and kwish) or coalesce(margin >= 1.3e0, false) as by_keyword,
    case when hits = 0 and kwish then 'keyword query had no meaningful BM25 hits'
      when margin >= 1.3e0 then 'BM25 top hit leads the runner-up ' || printf('%.2f', margin) || 'x'
      when hits = 0 and not coalesce(top >= 0.40e0, false) then 'hybrid fallback confidence was too low'
      when hits = 0 then 'BM25 returned no positive-score results'
      when hits = 1 then 'BM25 matched only one document'
      else 'no dominant BM25 hit (top leads runner-up ' || printf('%.2f', margin) || 'x)' end as reason,
    not ((hits = 0 and kwish) or (not coalesce(margin >= 1.3e0, false) and hits = 0 and not coalesce(top >= 0.40e0, false))) as answered
  from rr)"""

ADAPTIVE = (
    keyword(5)
    + hybrid(5)
    + ROUTES
    + """,
ad as (
  select qid, collection, path, chunk_index, rank, k.score, cast(null as double) as rrf, 'keyword' as source
  from kw k join rt using (qid, collection) where answered and by_keyword and rank <= 5
  union all
  select qid, collection, path, chunk_index, rank, h.score, h.rrf, 'hybrid' as source
  from hy h join rt using (qid, collection) where answered and not by_keyword)"""
)
