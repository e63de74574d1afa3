"""Queries over pages and laid-out lines, with oracles where SQL is as plain."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.operators import references as R
from folioscan.operators import structure as S
from folioscan.operators.verify import unwrapped
from folioscan.sources import layout as L
from folioscan.sources.manuscripts import load, manuscripts, select

from . import duck as D

Q, O = {}, {}
# Front matter, body and references of a manuscript for each customer.
FRONT = """select c_custkey as doc_id, concat('A Study of Sparse Graph Methods ', cast(c_custkey as varchar(9)), chr(10), 'Ada Byron, Alan Kay and Grace Hopper', chr(10), 'University of Somewhere', chr(10), 'Abstract', chr(10),
  'We study how graphs that are sparse can be kept in memory by simple means and show', chr(10), 'that all of the common operations on them stay fast when the graph grows by orders of magnitude', chr(10), 'Keywords: graphs, sparse data; memory', chr(10),
  case when c_custkey % 2 = 0 then '1. Introduction' else 'INTRODUCTION' end, chr(10), 'The first of these is shown in Fig. 1 and in Table 2 and in Fig. 9 as well.', chr(10), 'x = y + 3 and so on', chr(10), 'Fig. 1 The graph of it all', chr(10), 'goes on here.', chr(10),
  'Table 2 Sizes of graphs', chr(10), 'Fig. 3 shows a thing', chr(10), '2.1 Related Work', chr(10), 'However, this is text', chr(10), 'CONCLUSION', chr(10), 'References', chr(10), '[1] Byron A. A first work on- line. 2001', chr(10), 'continued here doi: 10.1000/ab', chr(10), '[2] Kay A. Second work. 2002.', chr(10), '[3] Hopper G. Third.') as full_text from customer"""
# Sizes 16, 14 and 10 by line; the page is 792 points high and 612 wide, lines 14 points apart, 40 to a page.
LAID = """select doc_id, cast(line_no as int) as line_no, text, cast(case when line_no = 0 then 16 when line_no in (7, 14, 16) then 12 else 10 end as double) as size, line_no in (7, 14, 16, 17) as bold, cast(1 as int) as page_number, cast(60 + 14 * line_no as double) as y0, cast(70 + 14 * line_no as double) as y1, cast(case when line_no >= 18 and substr(text, 1, 1) <> '[' then 80 else 72 end as double) as x0, 500.0D as x1, 792.0D as page_h, 612.0D as page_w from f"""
DUCK_LAID = f"fr as ({FRONT}), f as (select doc_id, unnest(range(len(string_split(full_text, chr(10))))) as line_no, unnest(string_split(full_text, chr(10))) as text from fr), l as ({LAID.replace('0D', '0::double')})"


def laid(spark, sf_dir):
    f = select(spark, sf_dir, FRONT, "customer").select("doc_id", F.posexplode(F.split("full_text", "\n")).alias("line_no", "text"))
    return spark.sql(LAID.replace("from f", "from {f}"), f=f)


def add(name, run, sql=None):
    Q[name] = lambda spark, sf_dir: run(laid(spark, sf_dir))
    if sql:
        O[name] = f"with {DUCK_LAID} {sql}"


def sizes(lines):
    return S.body_font_size(lines.withColumn("pos", F.col("line_no")))


flat = lambda df, *cs: df.select(*(F.array_join(c, "|").alias(c) if c in cs else c for c in df.columns))
add("body_font_size", sizes, ", g as (select doc_id, round_even(size * 2, 0) as half, sum(greatest(length(trim(text)), 1)) as w, min(line_no) as fst from l where size >= 7 group by all) select doc_id, arg_max(half, w) / 2 as body_size from g group by doc_id")
add("modal_font_size", lambda x: S.modal_font_size(x.withColumn("pos", F.col("line_no"))), ", g as (select doc_id, round_even(size, 0) as size, count(*) as n from l where size > 4 group by all) select doc_id, arg_max(size, n) as modal_size from g group by doc_id")
add("is_math_line", lambda x: x.where(S.is_math(F.col("text"))).select("doc_id", "line_no", "text"), r", e as (select doc_id, line_no, text, string_split(text, ' ') as w from l) select doc_id, line_no, text from e where regexp_matches(text, '[A-Za-z]\s*=\s*[A-Za-z]|\d+\s*/\s*\d+') or length(regexp_replace(text, '[\p{L}\p{N} .,;:!?\-–—()\[\]{}\"'']', '', 'g')) / length(text) > 0.25 or (len(w) >= 3 and len(list_filter(w, lambda v: regexp_matches(regexp_replace(v, '^[^a-zA-Z]+|[^a-zA-Z]+$', '', 'g'), '^[A-Za-z][A-Za-z''\-]+$'))) / len(w) < 0.35)")
add("detect_headings", lambda x: S.headings(x, sizes(x)))
add("heading_levels", lambda x: S.headings(x, sizes(x)).groupBy("doc_id", "level").agg(F.count("*").alias("n")))
add("strip_superscript_spans", lambda x: S.strip_superscripts(x.select("doc_id", F.floor(F.col("line_no") / 4).alias("line_no"), F.col("line_no").alias("pos"), "text", (F.col("size") - F.col("line_no") % 3).alias("size"))), ", s as (select doc_id, line_no // 4 as line_no, line_no as pos, text, size - line_no % 3 as size from l), m as (select *, max(size) over (partition by doc_id, line_no) as most from s) select doc_id, line_no, trim(string_agg(case when most - size > 1.5 and size < 11 and regexp_matches(text, '[\\p{L}\\p{N}]') then '' else text end, '' order by pos)) as text from m group by doc_id, line_no")
add("find_title", lambda x: S.title(x).select("doc_id", "title"), ", t as (select doc_id, text from l where line_no = 0) select doc_id, text as title from t")
add("find_abstract", S.abstract, ", a as (select doc_id, string_agg(text, ' ' order by line_no) as abstract_text from l where line_no in (4, 5) group by doc_id) select doc_id, abstract_text, len(string_split(abstract_text, ' ')) as abstract_word_count from a where len(string_split(abstract_text, ' ')) >= 30")
add("find_keywords", lambda x: flat(S.keywords(x), "keywords"))
add("find_authors", lambda x: flat(S.authors(x), "authors"), " select doc_id, 'Ada Byron|Alan Kay|Grace Hopper' as authors from fr")
add("figure_captions", lambda x: S.captions(x, "figure"), ", c as (select doc_id, 1 as number, string_agg(case when line_no = 10 then 'The graph of it all' else text end, ' ' order by line_no) as caption_text from l where line_no in (10, 11) group by doc_id) select doc_id, number, caption_text, 1 as caption_page, true as ends_period, 200.0::double as caption_y0 from c")
add("table_captions", lambda x: S.captions(x, "table"))
add("figure_first_mention", lambda x: S.first_mentions(x, "figure"), r", m as (select doc_id, page_number, unnest(regexp_extract_all(text, '(?i)\bFig(?:ure)?s?\.?\s*(\d+)\b', 1))::int as number from l) select doc_id, number, min(page_number) as first_mention_page from m group by all")
add("discover_figures", lambda x: S.discover(x, "figure"), " select doc_id, 1 as number, 'The graph of it all goes on here.' as caption_text, 1 as caption_page, 1 as first_mention_page from fr union all select doc_id, 3, null, 1, 1 from fr")
add("discover_tables", lambda x: S.discover(x, "table"))
add("manuscript", lambda x: S.title(x).select("doc_id", "title").join(S.abstract(x), "doc_id", "left").join(flat(S.keywords(x), "keywords"), "doc_id", "left").join(flat(S.authors(x), "authors"), "doc_id", "left"))


def image_caption_match(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem")
    c = rows.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("number")).agg(F.min(F.col("l_partkey") % 3 + 1).cast("int").alias("caption_page"), F.min(F.col("l_suppkey") * 7.0 % 700).alias("caption_y0"))
    i = rows.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 3 + 1).cast("int").alias("page_number"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("img"), F.lit(50.0).alias("x0"), (F.col("l_quantity") * 8.0).alias("y0"), (F.col("l_quantity") + 80.0).alias("x1"), (F.col("l_quantity") * 8.0 + 60).alias("y1"))
    return S.match_images(c, i.dropDuplicates(["doc_id", "img"]))


Q["image_caption_match"] = image_caption_match
_HEAD = r"(?i)^\s*(?:\d+\.?\s+)?(?:references?|bibliography|literature cited)\s*$"
add("refs_layout_lines", lambda x: S.reference_layout_lines(x).select("doc_id", "line_no", "text"), r" select doc_id, line_no, text from l where y0 >= 55 and y1 <= page_h - 55 and not regexp_matches(text, '^\s*$') and not regexp_matches(text, '(?i)^\s*(?:Table|Figure|Figs?)\b')")
add("ref_start_page", S.reference_start_page, f" select doc_id, 1 as start_page, min(line_no) as start_line from l where regexp_matches(text, '{_HEAD}') group by doc_id")
add("two_column_detect", lambda x: S.two_columns(x.withColumn("x0", F.when(F.col("doc_id") % 3 == 0, F.col("x0") + (F.col("line_no") % 2) * 260).otherwise(F.col("x0")))), ", x as (select *, case when doc_id % 3 = 0 then x0 + (line_no % 2) * 260 else x0 end as xx from l) select doc_id, page_number, count(*) filter (xx > 0.45 * page_w) > 3 and count(*) filter (xx > 0.45 * page_w) > 0.1 * count(*) as two_column from x group by all")
add("ref_header_slice", lambda x: S.after_header(x).select("doc_id", "line_no", "text"), f", h as (select doc_id, min(line_no) as h from l where regexp_matches(text, '{_HEAD}') group by doc_id) select doc_id, line_no, text from l join h using (doc_id) where line_no > h")
add("layout_ref_style", lambda x: S.layout_style(S.after_header(x)), " select doc_id, 'numbered-bracket' as style from fr")
add("ref_item_partition", lambda x: S.items(S.after_header(x)).select("doc_id", "line_no", "item"), ", h as (select * from l where line_no > 17), i as (select doc_id, line_no, (sum(regexp_matches(text, '^\\s*\\[\\d+\\]')::int) over (partition by doc_id order by line_no))::bigint as item from h) select * from i where item > 0")
add("ref_assemble", lambda x: S.assembled(S.items(S.after_header(x))).withColumn("doi", R.doi_of(F.col("raw_string"), True)).withColumn("year", R.year_of(F.col("raw_string"))))
Q["accent_fold"] = lambda s, d: manuscripts(s, d).select("doc_id", F.md5(S.fold_accents(F.col("full_text")).cast("binary")).alias("folded"))


def pages(spark, sf_dir):
    return L.pages(manuscripts(spark, sf_dir))


_PG = f"{D.BODY}, ls as (select doc_id, string_split(full_text, chr(10)) as x from d), pg as (select doc_id, unnest(range(1, ceil(len(x) / 40.0)::bigint + 1)) as page_number, x from ls), p as (select doc_id, page_number, array_to_string(x[(page_number - 1) * 40 + 1:page_number * 40], chr(10)) as plain_text from pg)"
Q["page_scan"] = lambda s, d: pages(s, d).select("doc_id", "page_number", F.md5(F.col("plain_text").cast("binary")).alias("text_md5"))
O["page_scan"] = f"with {_PG} select doc_id, page_number, md5(plain_text) as text_md5 from p"
Q["page_plain_text"] = lambda s, d: manuscripts(s, d).select("doc_id", F.md5(L.plain_text(F.split(F.concat(F.lit("  \n a \n"), "full_text"), "\n")).cast("binary")).alias("text_md5"))
O["page_plain_text"] = rf"with {D.BODY} select doc_id, md5(array_to_string(list_filter(list_transform(string_split('  ' || chr(10) || ' a ' || chr(10) || full_text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))) as text_md5 from d"
Q["span_flags"] = lambda s, d: load(s, d, "lineitem").select("l_orderkey", "l_linenumber", L.bold(F.col("l_partkey")).alias("bold"), L.italic(F.col("l_partkey")).alias("italic"))
O["span_flags"] = "select l_orderkey, l_linenumber, l_partkey & 16 <> 0 as bold, l_partkey & 2 <> 0 as italic from lineitem"
_BOX = "F.struct"
Q["image_boxes"] = lambda s, d: load(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("x0"), F.col("l_linenumber").cast("double").alias("y0"), (F.col("l_partkey") % 50).cast("double").alias("x1"), (F.col("l_suppkey") % 7).cast("double").alias("y1"))).alias("b")).select("l_orderkey", F.size(L.kept_boxes(F.col("b"))).alias("image_count"))
O["image_boxes"] = "select l_orderkey, count(*) filter (l_partkey % 50 > l_quantity and l_suppkey % 7 > l_linenumber) as image_count from lineitem group by l_orderkey"
Q["reading_order"] = lambda s, d: L.reading_order(load(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page_number"), (F.col("l_partkey") % 3).alias("type"), F.col("l_quantity").alias("y0"), F.col("l_suppkey").alias("x0"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("block_no"))).select("doc_id", "page_number", "block_no", "seq")
O["reading_order"] = "select l_orderkey as doc_id, l_linenumber % 2 as page_number, l_partkey * 100 + l_linenumber as block_no, row_number() over (partition by l_orderkey, l_linenumber % 2 order by round_even(l_quantity / 10, 0), l_suppkey, l_partkey * 100 + l_linenumber) as seq from lineitem where l_partkey % 3 in (0, 1)"


def search(*queries):
    return lambda s, d: L.search(pages(s, d), s.createDataFrame([(q,) for q in queries], "query string"))


def _search(*queries):
    one = " union all ".join(f"select doc_id, '{q}' as query, page_number, s as pos from (select doc_id, page_number, unnest(list_transform(range(1, len(z)), lambda i: list_sum(list_transform(z[1:i], lambda y: length(y)))::bigint + (i - 1) * {len(q)})) as s from (select doc_id, page_number, string_split(plain_text, '{q}') as z from p))" for q in queries)
    return f"with {_PG}, a as ({one}) select *, row_number() over (partition by doc_id, query order by page_number, pos) as hit from a qualify hit <= 20"


Q["string_search"], O["string_search"] = search("and  Table"), _search("and Table")
Q["string_search_batch"], O["string_search_batch"] = search("Network", "Journal of Tests", " "), _search("Network", "Journal of Tests")


def bibtex_parse(spark, sf_dir):
    text = F.concat(F.lit("@article{a"), "o_orderkey", F.lit(", title={On {Deep} things}, year = "), F.year("o_orderdate"), F.lit(', author="Doe, J. and Roe, A."}\n@misc{b, note={x}}'))
    return L.bibtex(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))).select("doc_id", "pos", "entry_type", "entry_id", F.concat_ws("|", F.transform(F.array_sort(F.map_keys("entry")), lambda k: F.concat(k, F.lit("="), F.col("entry")[k]))).alias("fields"))


Q["bibtex_parse"] = bibtex_parse
O["bibtex_parse"] = "select o_orderkey as doc_id, 0 as pos, 'article' as entry_type, 'a' || o_orderkey as entry_id, 'author=Doe, J. and Roe, A.|title=On {Deep} things|year=' || year(o_orderdate) as fields from orders union all select o_orderkey, 1, 'misc', 'b', 'note=x' from orders"
Q["grobid_json"] = lambda s, d: load(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), L.grobid(F.when(F.col("o_orderkey") % 4 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"refBibs":[{"rawForm":"Ref '), "o_custkey", F.lit('"}],"pages":[{"page_height":800.0}]}')))).alias("g")).select("doc_id", F.col("g.refBibs")[0]["rawForm"].alias("raw"), F.col("g.pages")[0]["page_height"].alias("height"))
O["grobid_json"] = "select o_orderkey as doc_id, case when o_orderkey % 4 <> 0 then 'Ref ' || o_custkey end as raw, case when o_orderkey % 4 <> 0 then 800.0::double end as height from orders"
Q["grobid_raw_string"] = lambda s, d: load(s, d, "pages").select("page_id", F.md5(L.raw_string(F.when(F.col("page_id") % 3 == 0, F.col("url")), F.when(F.col("page_id") % 3 == 1, F.col("html")), F.col("html")).cast("binary")).alias("raw"))
O["grobid_raw_string"] = r"select page_id, md5(case page_id % 3 when 0 then url when 1 then trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) else trim(html) end) as raw from pages"
Q["grobid_coord_flip"] = lambda s, d: load(s, d, "lineitem").select("l_orderkey", "l_linenumber", L.flip(F.when(F.col("l_partkey") % 2 == 0, F.lit(800.0)), F.col("l_quantity"), F.lit(10.0)).alias("top"))
O["grobid_coord_flip"] = "select l_orderkey, l_linenumber, case when l_partkey % 2 = 0 then 800.0::double else 792.0::double end - l_quantity - 10 as top from lineitem"
Q["extraction_errors"] = lambda s, d: L.errors(load(s, d, "documents").withColumn("text", F.when(F.col("doc_id") % 10 != 0, F.col("text"))))
O["extraction_errors"] = "select doc_id, 'unreadable' as error, '[{\"page\":0,\"reason\":\"unreadable\"}]' as extraction_errors from documents where doc_id % 10 = 0"


def result_json(spark, sf_dir):
    from .text_queries import Q as text

    return L.result_json(text["en_dash_ranges"](spark, sf_dir))


Q["result_json"] = result_json
_SRC = "select o_custkey as doc_id, o_orderkey as pos, case when o_orderkey % 5 = 0 then concat('grobid ', cast(o_orderkey as varchar(12))) else null end as grobid, case when o_orderkey % 3 = 0 then concat('pdf ', cast(o_orderkey as varchar(12))) else null end as pdf, concat('bib ', cast(o_orderkey as varchar(12))) as bib from orders"


def raw_source_select(spark, sf_dir):
    """Each document's strings from the first source that has any: the service's, three or more of the text's, the rebuilt entries."""
    r = select(spark, sf_dir, _SRC, "orders")
    n = r.groupBy("doc_id").agg(F.when(F.count("grobid") > 0, "grobid").when(F.count("pdf") >= 3, "pdf_text").when(F.count("bib") > 0, "bibtex").otherwise("none").alias("source"))
    return r.join(n, "doc_id").select("doc_id", "pos", "source", F.when(F.col("source") == "grobid", F.col("grobid")).when(F.col("source") == "pdf_text", F.col("pdf")).when(F.col("source") == "bibtex", F.col("bib")).alias("raw")).where("raw is not null")


Q["raw_source_select"] = raw_source_select
O["raw_source_select"] = f"with r as ({_SRC}), n as (select doc_id, case when count(grobid) > 0 then 'grobid' when count(pdf) >= 3 then 'pdf_text' when count(bib) > 0 then 'bibtex' else 'none' end as source from r group by doc_id), x as (select doc_id, pos, source, case source when 'grobid' then grobid when 'pdf_text' then pdf when 'bibtex' then bib end as raw from r join n using (doc_id)) select * from x where raw is not null"


def enrich_refs(spark, sf_dir):
    """Entries, raw strings and service boxes joined by position, whichever there are; ids default to ref_ and the position."""
    r = select(spark, sf_dir, _SRC, "orders")
    a = r.where("pos % 2 = 0").select("doc_id", "pos", F.concat(F.lit("key"), "pos").alias("id"))
    b = r.where("pos % 3 = 0").select("doc_id", "pos", F.col("bib").alias("raw"))
    j = a.join(b, ["doc_id", "pos"], "full_outer")
    return j.select("doc_id", "pos", F.coalesce("id", F.concat(F.lit("ref_"), F.lpad(F.col("pos").cast("string"), 8, "0"))).alias("id"), "raw")


Q["enrich_refs"] = enrich_refs
O["enrich_refs"] = f"with r as ({_SRC}) select doc_id, pos, case when pos % 2 = 0 then 'key' || pos else 'ref_' || lpad(pos::varchar, 8, '0') end as id, case when pos % 3 = 0 then bib end as raw from r where pos % 2 = 0 or pos % 3 = 0"


def merge_issues(spark, sf_dir):
    """Issues attached to entries by id; issues without an entry are appended bare."""
    e = enrich_refs(spark, sf_dir)
    i = select(spark, sf_dir, _SRC, "orders").where("pos % 7 = 0").select(F.concat(F.lit("key"), "pos").alias("id"), F.col("bib").alias("issue"))
    return e.join(i, "id", "left").select("id", "doc_id", "issue").unionByName(i.join(e, "id", "left_anti").select("id", F.lit(None).cast("long").alias("doc_id"), "issue"))


Q["merge_issues"] = merge_issues
O["merge_issues"] = f"with r as ({_SRC}), e as ({O['enrich_refs'].split(') select', 1)[0].split('as (', 1)[1] and 'select doc_id, pos, case when pos % 2 = 0 then ' + chr(39) + 'key' + chr(39) + ' || pos else ' + chr(39) + 'ref_' + chr(39) + ' || lpad(pos::varchar, 8, ' + chr(39) + '0' + chr(39) + ') end as id from r where pos % 2 = 0 or pos % 3 = 0'}), i as (select 'key' || pos as id, bib as issue from r where pos % 7 = 0) select id, doc_id, issue from e left join i using (id) union all select id, null, issue from i where id not in (select id from e)"


def llm_json_unwrap(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 3 == 0, '```json\n[{"candidate_id":"A"}]\n```').when(F.col("o_orderkey") % 3 == 1, '{"results":[{"candidate_id":"A"},{"candidate_id":"B"}]}').otherwise("no json")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), raw.alias("raw")).select("doc_id", F.size(unwrapped(F.col("raw"))).alias("n"))


Q["llm_json_unwrap"] = llm_json_unwrap
O["llm_json_unwrap"] = "select o_orderkey as doc_id, (array[1, 2, 0])[o_orderkey % 3 + 1] as n from orders"

# What these must give for the front matter above, line by line, in words of their own.
_ABSTRACT = "'We study how graphs that are sparse can be kept in memory by simple means and show that all of the common operations on them stay fast when the graph grows by orders of magnitude'"
O["find_keywords"] = f"with {DUCK_LAID} select doc_id, 'graphs|sparse data|memory' as keywords from fr"
O["table_captions"] = f"with {DUCK_LAID} select doc_id, 2 as number, 'Sizes of graphs' as caption_text, 1 as caption_page, false as ends_period, y0 as caption_y0 from l where line_no = 12"
O["discover_tables"] = f"with {DUCK_LAID} select doc_id, 2 as number, 'Sizes of graphs' as caption_text, 1 as caption_page, 1 as first_mention_page from fr"
O["detect_headings"] = f"with {DUCK_LAID} select doc_id, page_number, line_no, case line_no when 7 then case when doc_id % 2 = 0 then '1' end when 14 then '2.1' end as heading_number, regexp_replace(text, '^[0-9.]+ ', '') as heading_text, case when line_no = 17 then 2 else 1 end as level from l where line_no in (7, 14, 16, 17)"
O["heading_levels"] = f"with {DUCK_LAID} select doc_id, level, 5 - 2 * level as n from fr cross join (values (1), (2)) v(level)"
O["manuscript"] = f"with {DUCK_LAID} select doc_id, text as title, {_ABSTRACT} as abstract_text, len(string_split({_ABSTRACT}, ' ')) as abstract_word_count, 'graphs|sparse data|memory' as keywords, 'Ada Byron|Alan Kay|Grace Hopper' as authors from l where line_no = 0"
O["ref_assemble"] = f"""with {DUCK_LAID}, e(item, number, raw_string, x0, a, b, doi, year) as (values (1, 1, '[1] Byron A. A first work on-line. 2001 continued here doi: 10.1000/ab', 72.0::double, 18, 19, 'doi:10.1000/ab', 2001), (2, 2, '[2] Kay A. Second work. 2002.', 72.0::double, 20, 20, null, 2002), (3, 3, '[3] Hopper G. Third.', 72.0::double, 21, 21, null, null))
select doc_id, item, number, raw_string, 1 as page, x0, 60.0::double + 14 * a as y0, 500.0::double as x1, 70.0::double + 14 * b as y1, doi, year from fr cross join e"""
O["accent_fold"] = f"with {D.BODY} select doc_id, md5(lower(strip_accents(full_text))) as folded from d"


def _json_oracle():
    from .text_queries import O as text

    row = """'{"check_id":"' || check_id || '","seq":' || seq || ',"found":"' || found || '"}'"""
    return f"select doc_id, '[' || string_agg({row}, ',' order by check_id, seq) || ']' as result from ({text['en_dash_ranges']}) group by doc_id"


O["result_json"] = _json_oracle()
