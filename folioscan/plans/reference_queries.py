"""Queries over references and citations, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.operators import references as R
from folioscan.sources.manuscripts import manuscripts, select

from . import duck as D
from .numbering_queries import relation as _relation
from . import numbering_queries

Q, O = {}, {}
DEEP = "(select doc_id, full_text from m)"


def relation(name, run, base, table, sql):
    _relation(name, run, base, table, sql)
    Q[name], O[name] = numbering_queries.Q.pop(name), numbering_queries.O.pop(name)


def docs(spark, sf_dir):
    return manuscripts(spark, sf_dir).select("doc_id", "full_text")


_HEADS = r"(?im)^\s*(?:references|bibliography|literature cited|reference)\s*$"
_START = f"""h as (select doc_id, max(s) filter (s > length(o) * 0.5) as late, max(s) as last from ({D.spans('d', 'full_text', _HEADS)}) group by doc_id),
st as (select d.doc_id, full_text, coalesce(late, last, 0) as start from d left join h using (doc_id))"""
Q["reference_section_start"] = lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", R.section_start(F.col("full_text")).alias("start"))
O["reference_section_start"] = f"with {D.BODY}, {_START} select doc_id, start from st"
_OPEN = [p for p in R.OPENERS]
_STOPS = " or ".join([r"regexp_matches(line, '^\s*$')", "contains(line, 'ACCEPTED MANUSCRIPT')", *(f"regexp_matches(line, {D.lit(p)})" for p in R.BREAKS)])
_STYLE = "case " + " ".join(f"when regexp_matches(line, {D.lit(p)}) then {i}" for i, p in enumerate(_OPEN)) + " end"
_ENTRIES = rf"""{_START},
ln as (select doc_id, unnest(range(len(string_split(substr(full_text, start + 1), chr(10))))) as line_no, unnest(string_split(substr(full_text, start + 1), chr(10))) as line from st),
ls as (select *, {_STYLE} as style, {_STOPS} as stops from ln),
le as (select *, sum(case when style is not null or stops then 1 else 0 end) over (partition by doc_id order by line_no) as entry from ls),
la as (select *, row_number() over (partition by doc_id, entry order by line_no) as pos_in from le),
ee as (select doc_id, entry, max(case when pos_in = 1 then style end) as k, min(line_no) as pos, string_agg(trim(line), ' ' order by line_no) filter (trim(line) <> '') as raw_string from la where pos_in <= 7 group by doc_id, entry having k is not null),
ef as (select * from ee qualify row_number() over (partition by doc_id, k, lower(substr(raw_string, 1, 80)) order by pos) = 1),
en as (select *, count(*) over (partition by doc_id, k) as n from ef),
eb as (select *, first_value(k) over (partition by doc_id order by n desc, k) as best from en),
er as (select doc_id, ['numbered-bracket', 'dot-number', 'apa-style'][k + 1] as style, pos, case when k < 2 then regexp_extract(raw_string, '^\[?(\d+)', 1)::int end as number, raw_string,
  nullif(regexp_extract(raw_string, '\b((?:19|20)\d{{2}})\b', 1), '')::int as year, nullif(regexp_replace(regexp_extract(raw_string, '(?i)(?:doi\s*:\s*|https?://(?:dx\.)?doi\.org/)\s*(\S+)', 0), '\s+', '', 'g'), '') as doi, nullif(regexp_extract(raw_string, '(https?://\S+)', 1), '') as url from eb where k = best)"""


def entries_of(style: str | None):
    def run(spark, sf_dir):
        e = R.entries(docs(spark, sf_dir))
        return e.where(F.col("style") == style) if style else e

    return run


Q["reference_style_pick"] = entries_of(None)
O["reference_style_pick"] = f"with {D.BODY}, {_ENTRIES} select * from er"


# Lists in which each style wins, for the styles that the manuscripts' own list doesn't show.
LISTS = """select o_orderkey as doc_id, concat('Text', chr(10), 'References', chr(10),
  case when o_orderkey % 3 = 0 then '[1] Roe A. One' when o_orderkey % 3 = 1 then '1. Roe A. One' else 'Roe, A. (2001). One.' end, chr(10), '  continued ', cast(o_custkey as varchar(9)), chr(10),
  case when o_orderkey % 3 = 0 then '[2] Poe B. Two' when o_orderkey % 3 = 1 then '2. Poe B. Two https://a.org/x' else 'Poe, B. (2002). Two.' end, chr(10), chr(10), 'Table 3 follows') as full_text from orders"""
for key, style in (("refs_bracket", "numbered-bracket"), ("refs_dotnum", "dot-number"), ("refs_apa", "apa-style")):
    Q[key] = lambda spark, sf_dir, style=style: R.entries(select(spark, sf_dir, LISTS, "orders")).where(F.col("style") == style)
    O[key] = f"with d as ({LISTS}), {_ENTRIES} select * from er where style = '{style}'"
Q["ref_continuation"] = lambda spark, sf_dir: R.entries(select(spark, sf_dir, LISTS, "orders")).select("doc_id", "pos", "raw_string")
O["ref_continuation"] = f"with d as ({LISTS}), {_ENTRIES} select doc_id, pos, raw_string from er"


def field(name: str, column, sql: str) -> None:
    Q[name] = lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", column(F.col("full_text")).alias("value"))
    O[name] = f"with {D.BODY} select doc_id, {sql} as value from d"


field("ref_year", R.year_of, r"nullif(regexp_extract(full_text, '\b((?:19|20)\d{2})\b', 1), '')::int")
field("ref_doi", lambda c: F.concat_ws("|", R.doi_of(c), R.doi_of(c, True)), r"regexp_replace(regexp_extract(full_text, '(?i)(?:doi\s*:\s*|https?://(?:dx\.)?doi\.org/)\s*(\S+)', 0), '\s+', '', 'g') || '|' || regexp_replace(regexp_replace(regexp_extract(full_text, '(?i)(?:doi\s*:\s*|https?://(?:dx\.)?doi\.org/)\s*(\S+)', 0), '\s+', '', 'g'), '[.,;()\[\]{}]+$', '')")
field("ref_url", lambda c: R.url_of(F.concat(c, F.when(F.col("doc_id") % 2 == 0, " see https://example.org/a?b=1 .").otherwise(""))), r"nullif(regexp_extract(full_text || case when doc_id % 2 = 0 then ' see https://example.org/a?b=1 .' else '' end, '(https?://\S+)', 1), '')")


def in_text_citations(spark, sf_dir):
    d = docs(spark, sf_dir)
    return R.citations(d, R.entries(d))


Q["in_text_citations"] = in_text_citations
_AUTHOR = r"\([A-Z][a-zA-Z]+(?:\s+(?:and|&|et al\.?))?\s*(?:[A-Z][a-zA-Z]+)?(?:,\s*(?:19|20)\d{2})?\)"
_MAX = r"list_max(list_transform(regexp_extract_all(found, '(\d+)', 1), lambda x: x::int))"
_CITED = f"""{_ENTRIES}, rs as (select doc_id, count(*) as n_refs, max(number) as max_ref from er group by doc_id),
cc as (select c.*, n_refs, max_ref from ({D.spans('d', 'full_text', r'\[[1-9][\d,\s\-–]*\]', 0)} union all {D.spans('d', 'full_text', _AUTHOR, 1)}) c left join rs using (doc_id)),
cf as (select * from cc where k = 1 or n_refs is null or (max_ref is not null and (max_ref <= 0 or {_MAX} <= max_ref + 5)) qualify row_number() over (partition by doc_id, found order by k, s) = 1),
ci as (select doc_id, row_number() over (partition by doc_id order by k, s) as seq, found as marker, case k when 0 then 'numeric-bracket' else 'author-year' end as style, s as pos, trim(replace(substr(o, greatest(s - 60, 0) + 1, e + 60 - greatest(s - 60, 0)), chr(10), ' ')) as context_snippet from cf)"""
O["in_text_citations"] = f"with {D.BODY}, {_CITED} select * from ci"
MARKERS = "select l_orderkey as doc_id, l_linenumber, case when l_partkey % 5 = 0 then concat('[', cast(l_linenumber as varchar(9)), ',', cast(l_linenumber + l_partkey % 2 as varchar(9)), ']') when l_partkey % 5 = 1 then concat('[', cast(l_linenumber as varchar(9)), '-', cast(l_linenumber + l_partkey % 60 as varchar(9)), ']') when l_partkey % 5 = 2 then '(Smith, 2020)' when l_partkey % 5 = 3 then '[1; 3–5]' else '[7]' end as marker from lineitem"
_NUMS = r"""p as (select *, list_transform(regexp_split_to_array(regexp_replace(marker, '[\[\](){}]', ' ', 'g'), '[,;]\s*'), lambda x: trim(x)) as parts from r),
q as (select *, flatten(list_transform(parts, lambda x: case when regexp_matches(x, '^\d+\s*[-–—]\s*\d+') then case when regexp_extract(x, '^(\d+)\s*[-–—]\s*(\d+)', 2)::int - regexp_extract(x, '^(\d+)', 1)::int between 1 and 49 then range(regexp_extract(x, '^(\d+)', 1)::bigint, regexp_extract(x, '^(\d+)\s*[-–—]\s*(\d+)', 2)::bigint + 1) else []::bigint[] end when regexp_matches(x, '^\d+$') then [x::bigint] else []::bigint[] end)) as nums from p)"""
relation("parse_citation_numbers", lambda r: r.select("doc_id", "l_linenumber", "marker", F.array_join(F.transform(R.citation_numbers(F.col("marker")), lambda x: x.cast("string")), ",").alias("numbers")), MARKERS, "lineitem", f", {_NUMS} select doc_id, l_linenumber, marker, case when len(nums) = len(list_distinct(nums)) then array_to_string(nums, ',') else '' end as numbers from q")


def bidirectional_match(spark, sf_dir):
    lines = select(spark, sf_dir, "select l_orderkey as doc_id, l_linenumber as number, month(l_shipdate) as page, l_partkey * 100000 + l_suppkey as pos, l_returnflag from lineitem", "lineitem")
    return R.bidirectional(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag <> 'A'"))


Q["bidirectional_match"] = bidirectional_match
O["bidirectional_match"] = """with r as (select distinct l_orderkey as doc_id, l_linenumber as number from lineitem where l_returnflag = 'A'),
x as (select doc_id, max(number) as most from r group by doc_id),
t as (select l_orderkey as doc_id, l_linenumber as number, month(l_shipdate) as page, l_partkey * 100000 + l_suppkey as pos from lineitem where l_returnflag <> 'A'),
c as (select doc_id, number, arg_min(page, pos * 100 + page) as page from t left join x using (doc_id) where most is null or number <= most + greatest(5, floor(most * 0.2)) group by all),
b as (select doc_id, 'missing_from_refs' as type, number, page from c where not exists (select 1 from r where r.doc_id = c.doc_id and r.number = c.number)
  union all select doc_id, 'uncited_ref', number, null from r where not exists (select 1 from c where r.doc_id = c.doc_id and r.number = c.number) and (doc_id not in (select doc_id from t) or doc_id in (select doc_id from c)))
select *, row_number() over (partition by doc_id order by type, number) as seq from b"""
