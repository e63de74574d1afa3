"""DuckDB SQL for the queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""
with d as (select doc_id, {LOWER} as t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id is not distinct from max(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t)
"""

OP4 = r"""
with recursive d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, ([5.0::double, 2.0::double, 1.0::double])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from s
), c as (
  select *, 2.0::double * source_size as cap, 2.0::double * source_size / weight as fills from w
), l as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over up, 0)) / (sum(weight) over () - coalesce(sum(weight) over up, 0)) as level
  from c window up as (order by fills, source nulls last rows between unbounded preceding and 1 preceding)
), g as (
  select source, source_size, least(cap, weight * coalesce((select arg_min(level, fills) from l where level <= fills), 0)) as target from l
), e as (
  select row_number() over () as id, d.*, g.source_size, g.target, coalesce(d.source, chr(0)) as src, ('0x' || substr(md5('mix-1:' || coalesce(d.source, '')), 1, 6))::bigint as start
  from d join g on d.source is not distinct from g.source
), big as (
  select *, row_number() over (partition by src order by size desc, doc_id nulls first) as rank from e where size * 100 > source_size
), walk(src, rank, id, copies, prefix, taken, passed) as (
  select src, 0::bigint, -1::bigint, 0::bigint, min(start), 0::bigint, 0::bigint from e group by src
  union all
  select src, rank, id, copies, prefix, taken + copies * size, passed + size from (
    select b.src, b.rank, b.id, b.size, ((w.prefix + st) >> 24) - (w.prefix >> 24) as copies, w.prefix + st as prefix, w.taken, w.passed
    from walk w join (select * from big) b on b.src = w.src and b.rank = w.rank + 1, lateral (select floor(least(greatest((b.target - w.taken) / (b.source_size - w.passed), 0), 2.0::double) * 16777216)::bigint as st))
), z as (
  select * from walk qualify row_number() over (partition by src order by rank desc) = 1
), r as (
  select e.*, z.prefix, case when e.source_size > z.passed then floor(least(greatest((e.target - z.taken) / (e.source_size - z.passed), 0), 2.0::double) * 16777216)::bigint else 0 end as step,
    row_number() over (partition by e.src order by size, doc_id nulls first) as rank
  from e join z using (src) where size * 100 <= source_size
)
select doc_id, size, source_size, target, size * (((prefix + rank * step) >> 24) - ((prefix + (rank - 1) * step) >> 24)) as taken from r
union all
select e.doc_id, e.size, e.source_size, e.target, e.size * w.copies as taken from e join walk w on e.id = w.id
"""


def _spans(kind: str, pattern: str, group: int, least: int, options: str = "") -> str:
    """Matches of a pattern with their places, from the lengths of the matches and of what lies between them."""
    o = f", '{options}'" if options else ""
    return f"""
  select doc_id, '{kind}' as kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
    's': list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
    'n': length(m[i]), 'g': length(g[i])}})) as x
  from (select doc_id, regexp_extract_all(t, '{pattern}', 0{o}) as m, regexp_extract_all(t, '{pattern}', {group}{o}) as g, string_split_regex(t, '{pattern}') as parts from d)
  where len(m) > 0"""


_ASSIGN = """((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

OP5 = f"""
with d as (select row_number() over () as doc_key, doc_id, coalesce(text, '') as t from documents),
e as (
  select doc_key, kind, x.s as s, x.s + x.n as e, case kind when 'assign' then 0 when 'access' then 1 else 2 end as k from (
  {_spans("assign", _ASSIGN, 2, 6).replace("doc_id", "doc_key")} union all
  {_spans("access", "AKIA[A-Z0-9]+", 0, 20).replace("doc_id", "doc_key")} union all
  {_spans("hex", "[0-9a-f]+", 0, 24).replace("doc_id", "doc_key")})
  where x.g >= case kind when 'assign' then 6 when 'access' then 20 else 24 end
), a as (
  select doc_key, count(*) filter (kind = 'assign') as n1, count(*) filter (kind = 'access') as n2, count(*) filter (kind = 'hex') as n3,
    string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, k) as spans from e group by doc_key
)
select doc_id, coalesce(n1, 0) as n_assign, coalesce(n2, 0) as n_access, coalesce(n3, 0) as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (doc_key)
"""

OP7 = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and list_sum(list_transform(embedding, lambda x: x::double * x)) > 0
), l as (
  select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93
), r(x, y) as (
  select vec_id, vec_id from embeddings union select r.x, l.y from r join l on r.y = l.x
), n as (select x, count(*) as n from l group by x), c as (select x, min(y) as component_id from r group by x)
select vec_id, coalesce(n.n, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings left join n on vec_id = n.x join c on vec_id = c.x
"""

OP9 = """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select *, strlen(h) as n, max(page_id) over (partition by h) as m from p)
select page_id, n as payload_bytes, sha1(h) as payload_digest, case when n >= 1000 and page_id <> m then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id <> m then m end as refers_to
from q
"""

OP10 = rf"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) end) as s from w
), t as (select doc_id, len(s) as n, unnest(s) as t from s),
f as (select t.*, count(*) over (partition by t) as df from t),
k as (select *, row_number() over (partition by doc_id order by df, t) as at from f),
c as (
  select distinct a.doc_id as x, b.doc_id as y from k a join k b on a.t = b.t and a.doc_id < b.doc_id
  where a.at <= a.n - (90 * a.n + 99) // 100 + 1 and b.at <= b.n - (90 * b.n + 99) // 100 + 1
), l as (
  select x, y from c join s a on x = a.doc_id join s b on y = b.doc_id
  where 100 * len(list_intersect(a.s, b.s)) >= 90 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))
), b as (select x, y from l union all select y, x from l),
r(x, y) as (select doc_id, doc_id from documents union select r.x, b.y from r join b on r.y = b.x)
select doc_id, len(s)::bigint as n_shingles, m.y as component_id from s join (select x, min(y) as y from r group by x) m on doc_id = x
"""

ORACLES: dict[str, str] = {"op4_mixing": OP4, "op5_secrets": OP5, "op6_exact_dedup": OP6, "op7_embedding_dedup": OP7, "op9_warc": OP9, "op10_ngram_join": OP10}
