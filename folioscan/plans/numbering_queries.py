"""Queries over numbered entities, with their oracles. Orders stand for documents, their lines for figures, tables and equations."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import numbering as N
from folioscan.sources.manuscripts import manuscripts, select

from . import duck as D
from .text_queries import page_parts

Q, O = {}, {}
FIGURES = "select l_orderkey as doc_id, l_linenumber as number, month(l_shipdate) as first_mention_page, l_partkey, l_suppkey from lineitem where l_returnflag <> 'A'"
TABLES = FIGURES.replace("<> 'A'", "= 'A'")
BOXES = """select l_orderkey as doc_id, case when l_partkey % 7 = 0 then null else l_quantity * 10 end as caption_y0, case when l_suppkey % 5 = 0 then null else l_quantity * 10 + (l_partkey % 60) - 40 end as body_y0,
  l_quantity * 10 + 12 as caption_y1, case when l_suppkey % 5 = 1 then null else l_quantity * 10 + (l_partkey % 60) end as image_y0, l_linenumber % 3 as caption_page, l_partkey % 3 as image_page from lineitem"""
CAPTIONS = """select p_partkey as doc_id, p_size as number, concat('View', case when p_partkey % 4 = 0 then ' (a) left, (b) right' when p_partkey % 4 = 1 then ' (A) top, (c) end' when p_partkey % 4 = 2 then ' of (x)' else ' (b) two (c) three' end, case when p_size % 3 = 0 then ' and (d) more' else '' end) as caption_text from part"""
EQUATIONS = "select l_orderkey as doc_id, l_linenumber * (1 + l_orderkey % 3) as number, month(l_shipdate) as page_number, l_partkey * 100000 + l_suppkey as pos from lineitem where l_linenumber <> 2"
CONTEXTS = """select l_orderkey as doc_id, concat('(', cast(l_linenumber as varchar(10)), ')') as label, l_partkey * 100000 + l_suppkey as pos, case when l_partkey % 3 = 0 then 'we get E = mc2 ,  ' when l_partkey % 3 = 1 then 'so it holds.' else 'hence A = B ' end as context_before,
  case when l_suppkey % 4 = 0 then '  where x is the mass' when l_suppkey % 4 = 1 then 'In  which case' when l_suppkey % 4 = 2 then 'wherever it is' else 'such that y' end as context_after from lineitem"""


def relation(name: str, run, base: str, table: str, sql: str) -> None:
    Q[name] = lambda spark, sf_dir: run(select(spark, sf_dir, base, table))
    O[name] = f"with r as ({base}) {sql}"


SEQUENTIAL = """, g as (select doc_id, list_sort(list(number)) as f from r where number is not null group by doc_id),
h as (select doc_id, f, list_filter(range(1, list_max(f) + 1), lambda x: not list_contains(f, x)) as m from g),
k as (select doc_id, list_sort(list(number)) as a from (select doc_id, number from r group by all having count(*) > 1) group by doc_id)
select doc_id, array_to_string(f, ',') as found_sequence, array_to_string(m, ',') as missing_numbers, coalesce(array_to_string(a, ','), '') as duplicate_numbers, len(m) = 0 and a is null as passed from h left join k using (doc_id)"""
CHRONOLOGICAL = """, w as (select *, lag(first_mention_page) over o as pp, lag(number) over o as pn from r window o as (partition by doc_id order by number, l_partkey, l_suppkey, first_mention_page))
select doc_id, number, first_mention_page as page, pn as previous_number, pp as previous_page from w where first_mention_page < pp"""
for kind, base in (("figure", FIGURES), ("table", TABLES)):
    relation(f"{kind}_sequential_numbering", N.sequential, base, "lineitem", SEQUENTIAL)
    relation(f"{kind}_chronological_order", lambda r: N.chronological(r, ["l_partkey", "l_suppkey"]), base, "lineitem", CHRONOLOGICAL)
relation("table_caption_above", lambda r: N.caption_side(r, True), BOXES, "lineitem", "select doc_id, count(*) filter (caption_y0 > body_y0 + 15) as violations, count(*) filter (caption_y0 is null or body_y0 is null) as skipped, count(*) filter (caption_y0 > body_y0 + 15) = 0 as passed from r group by doc_id")
relation("figure_caption_below", lambda r: N.caption_side(r, False), BOXES, "lineitem", "select doc_id, count(*) filter (caption_page = image_page and caption_y1 < image_y0 - 15) as violations, count(*) filter (image_y0 is null or caption_page <> image_page) as skipped, count(*) filter (caption_page = image_page and caption_y1 < image_y0 - 15) = 0 as passed from r group by doc_id")
relation("figure_parts_mention", N.figure_parts, CAPTIONS, "part", r""", p as (select doc_id, number, list_sort(list_distinct(list_transform(regexp_extract_all(caption_text, '\(([a-zA-Z])\)', 1), lambda x: lower(x)))) as p from r),
q as (select *, list_filter(list_transform(range(97, ascii(p[-1]) + 1), lambda c: chr(c::int)), lambda c: not list_contains(p, c)) as m from p where len(p) > 0 and (list_contains(p, 'a') or (len(p) >= 2 and ascii(p[-1]) - ascii(p[1]) + 1 = len(p))))
select doc_id, number, array_to_string(p, ',') as found_parts, case when p[1] = 'a' then array_to_string(m, ',') else '' end as missing_parts, p[1] = 'a' as starts_at_a from q where p[1] <> 'a' or len(m) > 0""")
relation("equation_sequential_numbering", N.equation_gaps, EQUATIONS, "lineitem", """, o as (select doc_id, number, arg_min(page_number, pos * 100 + page_number) as page from r where number >= 1 group by all),
w as (select *, count(*) over (partition by doc_id) as n, lead(number) over (partition by doc_id order by number) as after from o)
select doc_id, row_number() over (partition by doc_id order by number) as seq, number + 1 as number, after - 1 as upto, page from w where n >= 3 and after - number >= 2 qualify seq <= 20""")
relation("equation_punctuation", N.equation_punctuation, CONTEXTS, "lineitem", r""", t as (select *, trim(context_after) as a, trim(context_before) as b from r)
select doc_id, row_number() over (partition by doc_id order by pos, label, a) as seq, label, substr(a, 1, 60) as evidence from t where regexp_matches(a, '(?i)^(?:where|with|in\s+which|such\s+that)\b') and not regexp_matches(b, '[,.]$') qualify seq <= 20""")


def in_text_reference_consistency(spark, sf_dir):
    m = manuscripts(spark, sf_dir).select("doc_id", T.let(page_parts("full_text"), lambda p: F.array_join(p, "\n")).alias("full_text"), T.page_offsets(page_parts("full_text")).alias("offsets"))
    return N.callout_styles(m)


Q["in_text_reference_consistency"] = in_text_reference_consistency
_STYLES = "[" + ", ".join(D.lit(n) for n, _ in N.CALLOUTS) + "]"
_CALLS = " union all ".join(D.spans("p", "t", "(?i)" + p, i) for i, (_, p) in enumerate(N.CALLOUTS))
_PAGES = "list_transform(range(0, greatest(ceil(length(full_text) / 400.0)::bigint, 1)), lambda i: substr(full_text, i * 400 + 1, 400))"
O["in_text_reference_consistency"] = f"""with {D.BODY}, p as (select doc_id, array_to_string({_PAGES}, chr(10)) as t from d), c as ({_CALLS}),
s as (select *, case when k = 3 and max(case when k = 1 then 1 end) over (partition by doc_id) = 1 then 1 else k end as style from c),
n as (select *, count(*) over (partition by doc_id, style) as n from s),
w as (select *, first_value(style) over (partition by doc_id order by n desc, style) as dominant from n),
x as (select * from w where style <> dominant qualify row_number() over (partition by doc_id, style order by k, s) <= 10)
select doc_id, row_number() over (partition by doc_id order by style, k, s) as seq, {_STYLES}[style + 1] as style, {_STYLES}[dominant + 1] as dominant, s as pos, s // 401 + 1 as page, found,
  trim(replace(substr(o, greatest(s - 40, 0) + 1, s + 40 - greatest(s - 40, 0)), chr(10), ' ')) as evidence from x qualify seq <= 20"""


def bundle(name: str, *parts: str) -> None:
    def run(spark, sf_dir):
        out = None
        for p in parts:
            df = Q[p](spark, sf_dir)
            bad = df.where("not passed") if "passed" in df.columns else df
            rows = bad.groupBy(F.lit(p).alias("check_id"), "doc_id").agg(F.count("*").alias("n"))
            out = rows if out is None else out.union(rows)
        return out

    Q[name] = run
    O[name] = " union all ".join(f"select '{p}' as check_id, doc_id, count(*) as n from ({O[p]}){' where not passed' if ' as passed' in O[p] else ''} group by doc_id" for p in parts)


bundle("figures_tables_all", "figure_sequential_numbering", "table_sequential_numbering", "figure_chronological_order", "table_chronological_order", "table_caption_above", "figure_caption_below", "figure_parts_mention")
bundle("equation_checks_all", "equation_sequential_numbering", "equation_punctuation", "in_text_reference_consistency")

WORDS = """select l_orderkey as doc_id, 1 + l_linenumber % 2 as page_number, 600.0 as page_w, 800.0 as page_h, 1 as block_no, l_linenumber % 3 as line_no,
  case when l_partkey % 6 = 0 then '(A12)' when l_partkey % 6 = 1 then concat('(', cast(l_partkey as varchar(12)), ')') when l_partkey % 6 = 2 then '(2019)' when l_partkey % 6 = 3 then '(1.2)' when l_partkey % 6 = 4 then 'word' else '(3b)' end as text,
  cast(l_partkey % 590 as double) as x0, cast(l_suppkey % 800 as double) as y0, cast(l_partkey % 590 + 8 as double) as x1, cast(l_suppkey % 800 + 10 as double) as y1 from lineitem"""
relation("equation_labels", N.equation_labels, WORDS, "lineitem", r""", w as (select *, row_number() over o as rn, lead(x1) over o as prev from r window o as (partition by doc_id, page_number, block_no, line_no order by x0 desc, text)),
l as (select *, regexp_extract(text, '^\(([A-Za-z]?\d+[A-Za-z]?(?:\.\d+)?)\)$', 1) as lab from w where rn = 1 and x0 > 0.35 * page_w and y0 >= 50 and y1 <= page_h - 50 and not regexp_matches(text, '^\((?:19|20)\d{2}\)$')),
n as (select *, case when regexp_matches(lab, '\.') then null else regexp_extract(lab, '\d+')::int end as number from l where lab <> '' and (prev is null or x0 - prev >= 10))
select doc_id, number, text as label, page_number, x0, y0 from n where number is null or number between 1 and 200""")
relation("equation_label_parse", lambda r: r.select("doc_id", "label").withColumn("number", N.label_number(F.col("label"))), "select l_orderkey as doc_id, l_linenumber, concat(case when l_partkey % 3 = 0 then 'A.' when l_partkey % 3 = 1 then 'B' else '' end, cast(l_partkey % 300 as varchar(9)), case when l_suppkey % 3 = 0 then 'a' when l_suppkey % 3 = 1 then '.2' else '' end) as label from lineitem", "lineitem", r"select doc_id, label, case when regexp_matches(label, '\.2$') then null else regexp_extract(label, '\d+')::int end as number from r")
relation("equation_dedupe", N.equation_dedupe, "select l_orderkey as doc_id, case when l_partkey % 4 = 0 then null else l_linenumber % 4 end as number, month(l_shipdate) as page_number, l_partkey * 100000 + l_suppkey as y0 from lineitem", "lineitem", "select doc_id, number, page_number, y0 from r qualify number is null or row_number() over (partition by doc_id, number order by page_number, y0) = 1")
Q["equation_context"] = lambda spark, sf_dir: N.equation_context(manuscripts(spark, sf_dir).select("doc_id", F.concat(F.lit("("), F.col("doc_id") % 5 + 1, F.lit(")")).alias("label"), F.col("full_text").alias("page_text")))
O["equation_context"] = rf"""with {D.BODY}, e as (select doc_id, '(' || (doc_id % 5 + 1) || ')' as label, full_text as t from d), p as (select *, length(t) - instr(reverse(t), reverse(label)) - length(label) + 1 as i from e)
select doc_id, label, case when contains(t, label) then regexp_replace(substr(t, greatest(i - 400, 0) + 1, least(i, 400)), '^\s+|\s+$', '', 'g') else '' end as context_before,
  case when contains(t, label) then regexp_replace(substr(t, i + length(label) + 1, 400), '^\s+|\s+$', '', 'g') else '' end as context_after from p"""
