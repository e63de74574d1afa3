"""Queries of the reference analyser, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.operators import analyser as A
from folioscan.operators import classifier as C
from folioscan.sources.manuscripts import load, select

Q, O = {}, {}
_Y = "cast(1990 + o_custkey % 35 as varchar(4))"
# Reference strings of every style, by the order's number.
RAW = f"""select o_custkey as doc_id, o_orderkey as pos, case o_orderkey % 12
  when 0 then concat('[', cast(o_orderkey % 90 + 1 as varchar(9)), '] A. Smith and B. Jones, "Deep learning for signals," IEEE Trans. Neural, vol. 3, no. 4, pp. 12-45, ', {_Y}, ', doi: 10.1109/TNN.', {_Y}, '.1')
  when 1 then concat('Doe, J. (', {_Y}, '). Title of a work that goes on a while longer. Journal of Tests, 4(2), 1-9. https://doi.org/10.1000/x', cast(o_orderkey as varchar(12)))
  when 2 then concat('Roe AB, Poe CD. Short note. N Engl J Med. ', {_Y}, ';38(5):45-63.')
  when 3 then concat('Smith, John. "A long enough title." Journal of Things, vol. 5, no. 2, ', {_Y}, ', pp. 1-20.')
  when 4 then concat('Brown, T. and Green, P. (', {_Y}, ') ''Work of note'', Place: Oxford University Press. Available at: http://x.org (Accessed: 2 May)')
  when 5 then concat('1. Roe A. A note on it. Publisher; ', {_Y}, '.')
  when 6 then concat('World Health Organization (', {_Y}, ') Guidelines for all. Geneva: Health Press.')
  when 7 then concat('Jane Smith. "A page title here." Site, ', {_Y}, ', www.site.org. Accessed 4 May.')
  when 8 then concat('ISO/IEC 27001 Information security, ', {_Y})
  when 9 then concat('Lee, K., & Park, S. (', {_Y}, '). On that. Retrieved May 4 from http://a.b')
  when 10 then concat('[', cast(o_orderkey % 90 + 1 as varchar(9)), '] Roe AB, Poe CD, et al. Note. J Am Soc. ', {_Y}, ' [Internet]')
  else concat('untitled note ', cast(o_orderkey as varchar(12))) end as raw from orders"""


def rel(name, run, base, table, sql):
    Q[name] = lambda spark, sf_dir: run(select(spark, sf_dir, base, table))
    O[name] = f"with r as ({base}){sql}"


def styled(r):
    return r.select("doc_id", "pos", C.classify(F.col("raw")).alias("c")).select("doc_id", "pos", "c.*")


CLASSIFIED = ", " + C.oracle("r", "raw", "doc_id, pos")
rel("classify_reference", styled, RAW, "orders", f"{CLASSIFIED} select * from cl")
_VOTE = """, v as (select doc_id, confidence, style, count(*) as n, min(pos) as first from cl group by all), t as (select *, sum(n) over (partition by doc_id, confidence) as total from v where true),
w as (select * from t qualify row_number() over (partition by doc_id, confidence order by n desc, first) = 1),
dominant as (select doc_id, style as dominant from w where n >= 0.25 * total and style <> 'Unknown' qualify row_number() over (partition by doc_id order by list_position(['HIGH', 'MEDIUM', 'LOW'], confidence)) = 1)"""
rel("detect_citation_style", lambda r: A.dominant_style(styled(r)), RAW, "orders", f"{CLASSIFIED}{_VOTE} select doc_id, dominant from dominant")
rel("style_conformity", lambda r: A.style_conformity(styled(r)), RAW, "orders", f"{CLASSIFIED}{_VOTE} select cl.doc_id, pos, style, dominant from cl join dominant using (doc_id) where confidence <> 'LOW' and style <> dominant")
_LABEL = r"try_cast(nullif(regexp_extract(raw, '^\[?(\d+)\]?\.?\s', 1), '') as int)"
LABELLED = RAW.replace("case o_orderkey % 12", "case o_orderkey % 12 when 11 then concat('[', cast(o_orderkey % 3 + 1 as varchar(9)), '] x y')")
rel("ordering_numeric", A.numeric_order, LABELLED, "orders", f""", l as (select doc_id, pos, {_LABEL} as label from r),
e as (select *, coalesce(last_value(label ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) + 1, 1) as expected from l)
select * from e where label is null or label <> expected""")
BIB = """select o_custkey as doc_id, o_orderkey as pos, o_orderkey % 5 as kind, concat(case o_orderkey % 4 when 0 then 'van Berg' when 1 then 'De Luca' when 2 then 'Zhou' else 'Adams' end, ', ', 'K') as author, case when o_orderkey % 6 = 0 then null else concat('On topic ', cast(o_orderkey % 17 as varchar(9))) end as title,
  case o_orderkey % 7 when 0 then 'Journal of Tests' when 1 then 'journal of tests' when 2 then 'Journal Of Tests' when 3 then 'JOURNAL OF TESTS' when 4 then 'A review of fog computing for the internet of things and beyond. Big Data and Cognitive Computing' else null end as journal, case when o_orderkey % 4 = 1 then 'Old Press' else null end as publisher,
  case when o_orderkey % 9 = 0 then '' else cast(year(o_orderdate) as varchar(4)) end as year, case when o_orderkey % 3 = 0 then null else cast(o_orderkey % 40 as varchar(4)) end as volume, case when o_orderkey % 5 = 0 then null when o_orderkey % 11 = 0 then '2004' else '12-45' end as pages, case when o_orderkey % 2 = 0 then null else '10.1/x' end as doi, case when o_orderkey % 8 = 0 then 'http://a.b' else null end as url,
  concat('Ref ', cast(o_orderkey as varchar(12)), case when o_orderkey % 3 = 1 then ' (2001) and more accessed' else ' vol. 3 2001;4' end) as raw from orders"""
rel("infer_ref_type", lambda r: r.select("doc_id", "pos", A.ref_type().alias("type")), BIB, "orders", " select doc_id, pos, case when journal is not null and publisher is not null then 'chapter' when journal is not null then 'article' when publisher is not null then 'book' when url is not null then 'web' else 'other' end as type from r")
_TYPE = "case when journal is not null and publisher is not null then 'chapter' when journal is not null then 'article' when publisher is not null then 'book' when url is not null then 'web' else 'other' end"
_SCHEMA = "(values " + ", ".join(str(x) for x in A.schema_rows()) + ") sc(style, type, field, level, n)"
rel("completeness_fields", A.completeness, BIB, "orders", f""", t as (select *, {_TYPE} as type, (['IEEE', 'APA', 'MLA', 'HARVARD', 'VANCOUVER'])[kind + 1] as style from r),
f as (select doc_id, pos, style, type, unnest([{{'f': 'authors', 'v': author}}, {{'f': 'title', 'v': title}}, {{'f': 'container_title', 'v': journal}}, {{'f': 'pub_date', 'v': year}}, {{'f': 'volume', 'v': volume}}, {{'f': 'issue', 'v': null}}, {{'f': 'pages', 'v': pages}}, {{'f': 'doi', 'v': doi}}, {{'f': 'url', 'v': url}}, {{'f': 'publisher', 'v': publisher}}]) as x from t)
select doc_id, pos, f.style, f.type, x.f as field, case level when 'required' then 'missing' else 'suspicious' end as issue_type from f join {_SCHEMA} on sc.style = f.style and sc.type = f.type and sc.field = x.f where coalesce(trim(x.v), '') = ''""")
_FMT = """, t as (select *, (['IEEE', 'APA', 'MLA', 'HARVARD', 'VANCOUVER'])[kind + 1] as style, %s as type from r)
select doc_id, pos, style, issue from (
  select *, unnest([
    case when style in ('APA', 'HARVARD') and year <> '' and not regexp_matches(raw, '\\(\\d{4}\\)') then 'year_parentheses' end,
    case when style = 'MLA' and pages is not null and not regexp_matches(raw, '\\bpp?\\.\\s') and type in ('article', 'chapter') then 'pages_pp' end,
    case when style = 'MLA' and regexp_matches(volume, '^\\d+$') and not regexp_matches(raw, '(?i)\\bvol\\.\\s*\\d') then 'volume_label' end,
    case when style = 'MLA' and year <> '' and regexp_matches(raw, '\\b(?:19|20)\\d{2}\\b') and contains(raw, year) and length(raw) - instr(reverse(raw), reverse(year)) - 3 < length(raw) * 0.4 then 'year_early' end,
    case when style = 'VANCOUVER' and year <> '' and volume is not null and pages is not null and not regexp_matches(raw, '\\d{4};\\d+') then 'year_volume_pages' end,
    case when regexp_matches(pages, '^(?:19|20)\\d{2}$') then 'pages_year' end,
    case when regexp_matches(volume, '^(?:[1-9]|[12]\\d|3[01])$') and regexp_matches(raw, '(?i)\\b(?:accessed|retrieved|cited)\\b') then 'volume_day' end,
    case when year <> '' and not regexp_matches(year, '^(?:19|20)\\d{2}$') then 'date_not_year' end]) as issue from t) where issue is not null""" % _TYPE
rel("completeness_formatting", A.formatting, BIB, "orders", _FMT)
rel("doi_missing", A.doi_missing, BIB, "orders", f" select doc_id, pos from r where {_TYPE} in ('article', 'chapter') and coalesce(doi, '') = '' and not regexp_matches(raw, '(?i)(?:doi\\s*:\\s*|https?://(?:dx\\.)?doi\\.org/)\\s*\\S+|\\b10\\.\\d{{4,9}}/\\S+')")
rel("ordering_alpha", A.alpha_order, BIB, "orders", """, k as (select doc_id, pos, regexp_replace(lower(regexp_extract(author, '^([^,]+)', 1)), '^(?:van der|van den|van de|von der|degli|della|del|van|von|mac|las|les|de|di|du|da|le|la|el|al|mc) ', '') || '_' || case when year = '' then '9999' else substr(year, 1, 4) end as sort_key from r),
w as (select *, lag(sort_key) over (partition by doc_id order by pos) as previous from k) select doc_id, pos, sort_key, previous from w where sort_key < previous""")
_J = r"case when length(journal) <= 60 then journal else coalesce(nullif(regexp_extract(journal, '\.\s+([A-Z][^.]{4,})$', 1), ''), journal) end"
rel("journal_extract", lambda r: r.where("journal is not null").select("doc_id", "pos", A.journal_of("journal").alias("journal")), BIB, "orders", f" select doc_id, pos, {_J} as journal from r where journal is not null")
rel("journal_casing_consistency", A.journal_casing, BIB, "orders", rf""", j as (select doc_id, pos, {_J} as journal from r where journal is not null), g as (select *, trim(regexp_replace(regexp_replace(lower(journal), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) as key from j),
n as (select doc_id, key, journal, count(*) as n, min(pos) as first from g group by all), d as (select doc_id, key, journal as dominant from n qualify row_number() over (partition by doc_id, key order by n desc, first) = 1 and count(*) over (partition by doc_id, key) > 1)
select g.doc_id, pos, journal, dominant from g join d using (doc_id, key) where journal <> dominant""")
_EX = "(" + ", ".join(f"'{w}'" for w in A.SMALL_WORDS) + ")"
_WORDS = r"string_split(trim(journal), ' ')"
rel("casing_label", lambda r: r.where("journal is not null").select("doc_id", "pos", A.casing_label(F.col("journal")).alias("label")), BIB, "orders", rf""", j as (select doc_id, pos, journal, {_WORDS} as w from r where journal is not null)
select doc_id, pos, case when upper(journal) = journal then 'ALL_CAPS' when lower(journal) = journal then 'all_lowercase'
  when len(list_filter(range(1, len(w) + 1), lambda i: case when lower(trim(w[i], '.,;:!?()[]')) in {_EX} and i > 1 and i < len(w) then regexp_matches(w[i], '^[A-Z]') else regexp_matches(w[i], '^[a-z]') end)) = 0 then 'Title Case'
  when len(list_filter(w[2:], lambda x: regexp_matches(x, '^[a-z]'))) * 2 >= len(w) - 1 then 'Sentence case' else 'Mixed/inconsistent case' end as label from j""")
rel("to_title_case", lambda r: r.where("journal is not null").select("doc_id", "pos", A.title_case(F.col("journal")).alias("titled")), BIB, "orders", rf""", j as (select doc_id, pos, {_WORDS} as w from r where journal is not null)
select doc_id, pos, array_to_string(list_transform(range(1, len(w) + 1), lambda i: case when lower(trim(w[i], '.,;:!?()[]')) in {_EX} and i > 1 and i < len(w) then lower(w[i]) else upper(w[i][1]) || w[i][2:] end), ' ') as titled from j""")
rel("bibtex_authors", lambda r: r.select("doc_id", "pos", F.array_join(A.authors_of(F.concat("author", F.lit(" and Ada Byron"))), "; ").alias("authors")), BIB, "orders", r" select doc_id, pos, trim(string_split(author, ',')[2]) || ' ' || trim(string_split(author, ',')[1]) || '; Ada Byron' as authors from r")
ENTRY = "case kind when 0 then 'article' when 1 then 'inproceedings' when 2 then 'inbook' when 3 then 'misc' else 'article' end"
_FIELDS = "list_filter(['author', case when title is not null then 'title' end, case when journal is not null then 'journal' end, case when year <> '' then 'year' end, case when volume is not null then 'volume' end, case when pages is not null then 'pages' end, case when doi is not null then 'doi' end, case when publisher is not null then 'publisher' end], lambda x: x is not null)"
_NEED = "case kind when 1 then ['author', 'booktitle', 'title', 'year'] when 2 then ['author', 'publisher', 'title', 'year'] when 3 then []::varchar[] else ['author', 'journal', 'title', 'year'] end"
rel("bibtex_required_fields", A.required_fields, BIB, "orders", f", m as (select doc_id, pos, list_sort(list_filter({_NEED}, lambda x: not list_contains({_FIELDS}, x))) as m from r) select doc_id, pos, array_to_string(m, ',') as missing from m where len(m) > 0")
_EXTRA = f"list_sort(list_filter({_FIELDS}, lambda x: not list_contains({_NEED}, x) and x not in ('title', 'author', 'year', 'month', 'note', 'abstract')))"
rel("bibtex_field_consistency", A.field_consistency, BIB, "orders", f""", e as (select doc_id, pos, {ENTRY} as type, {_EXTRA} as x from r), f as (select *, first_value(x) over (partition by doc_id, type order by pos) as p from e)
select doc_id, pos, type, array_to_string(list_sort(list_concat(list_filter(x, lambda a: not list_contains(p, a)), list_filter(p, lambda a: not list_contains(x, a)))), ',') as differing from f where x <> p""")
rel("bibtex_misc_warning", lambda r: r.where("kind = 3 and (year = '' or (author is null and title is null))").select("doc_id", "pos"), BIB, "orders", " select doc_id, pos from r where kind = 3 and (year = '' or (author is null and title is null))")
rel("bibtex_reconstruct", lambda r: A.reconstruct(r), BIB, "orders", """ select doc_id, pos, concat_ws(' ', '[' || row_number() over (partition by doc_id order by pos) || ']', author || '.', '"' || title || '."', journal, 'vol. ' || volume, case when year <> '' then '(' || year || ')' end, 'pp. ' || pages, 'doi:' || doi) as raw_string from r""")


def crossref(spark, sf_dir):
    """Titles looked up among documents flagged as missing a DOI; the local table stands for the online service."""
    table = load(spark, sf_dir, "part").select(F.concat(F.lit("On topic "), F.col("p_partkey") % 17).alias("t"), F.concat(F.lit("10.5/"), F.col("p_partkey")).alias("d"), (F.col("p_size") * 2).alias("score"))
    best = table.groupBy("t").agg(F.max(F.struct("score", "d")).alias("b")).where("b.score >= 50")
    r = select(spark, sf_dir, BIB, "orders")
    flagged = A.doi_missing(r).join(r.select("doc_id", "pos", "title"), ["doc_id", "pos"]).where("title is not null")
    return flagged.join(best, F.col("title") == F.col("t")).select("doc_id", "pos", "title", F.col("b.d").alias("doi"), F.col("b.score").cast("long").alias("score"))


Q["doi_deep_check"] = crossref
O["doi_deep_check"] = f"""with r as ({BIB}), c as (select 'On topic ' || (p_partkey % 17) as t, '10.5/' || p_partkey as d, p_size * 2 as score from part), b as (select t, d, score from c qualify row_number() over (partition by t order by score desc, d desc) = 1)
select doc_id, pos, title, d as doi, score::bigint as score from r join b on title = t where score >= 50 and {_TYPE} in ('article', 'chapter') and coalesce(doi, '') = ''"""


def bibtex_to_parsed(spark, sf_dir):
    r = select(spark, sf_dir, BIB, "orders").withColumn("booktitle", F.when(F.col("pos") % 2 == 0, F.lit("Proc. of Tests"))).withColumn("date", F.lit("2011-01")).withColumn("entry_type", A.entry_type())
    return r.select("doc_id", "pos", *A.parsed_fields())


Q["bibtex_to_parsed"] = bibtex_to_parsed
O["bibtex_to_parsed"] = f"with r as ({BIB}) select doc_id, pos, trim(string_split(author, ',')[2]) || ' ' || trim(string_split(author, ',')[1]) as authors, coalesce(title, '') as title, coalesce(journal, case when pos % 2 = 0 then 'Proc. of Tests' end, '') as container_title, case when year = '' then '2011-01' else year end as pub_date, {ENTRY} as entry_type from r"
_LABELS = O["casing_label"].split("with r as", 1)[1]
_TITLED = O["to_title_case"].split("with r as", 1)[1]
rel("journal_casing_style", A.casing_by_style, BIB, "orders", f""", lb as (with r2 as {_LABELS.replace(" from r where", " from r where")}), tt as (with r3 as {_TITLED}),
k as (select r.doc_id, r.pos, journal, (['IEEE', 'APA', 'MLA', 'HARVARD', 'VANCOUVER'])[kind + 1] as style, label, titled from r join lb on r.doc_id = lb.doc_id and r.pos = lb.pos join tt on r.doc_id = tt.doc_id and r.pos = tt.pos),
t as (select *, case when label = 'ALL_CAPS' and length(journal) > 4 then 'all_caps' when label = 'all_lowercase' and contains(journal, ' ') then 'wrong_case' when style <> 'VANCOUVER' and label not in ('ALL_CAPS', 'Title Case') then 'wrong_case' when style = 'VANCOUVER' and label = 'all_lowercase' then 'wrong_case' end as issue_type from k)
select doc_id, pos, journal, style, issue_type, case when issue_type = 'all_caps' then array_to_string(list_transform(string_split(lower(journal), ' '), lambda w: upper(w[1]) || w[2:]), ' ') else titled end as suggestion from t where issue_type is not null""")


def _union(*parts):
    return " union all ".join(f"select doc_id, {i} as check_no, '{c}' as \"check\", pos, {f} as field from ({O[q]})" for i, (c, q, f) in enumerate(parts))


_PARTS = (("ordering", "ordering_alpha", "''"), ("doi", "doi_missing", "''"), ("journal_casing", "journal_casing_consistency", "''"), ("completeness", "completeness_fields", "field"))


def entries(spark, sf_dir):
    return select(spark, sf_dir, BIB, "orders")


Q["reference_quality_issues"] = lambda s, d: A.quality_issues(entries(s, d))
O["reference_quality_issues"] = f"select doc_id, row_number() over (partition by doc_id order by check_no, pos, field) as seq, \"check\", pos, field from ({_union(*_PARTS)}) qualify seq <= 50"
Q["all_quality_issues"] = lambda s, d: A.quality_issues(entries(s, d), styled(select(s, d, RAW, "orders")), None)
O["all_quality_issues"] = f"select doc_id, row_number() over (partition by doc_id order by check_no, pos, field) as seq, \"check\", pos, field from ({_union(*_PARTS, ('style_conformity', 'style_conformity', chr(39) * 2))})"
