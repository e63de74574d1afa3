"""Queries over manuscript text, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import text_checks as C
from folioscan.sources.manuscripts import manuscripts

from . import duck as D

Q, O = {}, {}


def check_query(name: str, run) -> None:
    Q[name] = lambda spark, sf_dir: run(manuscripts(spark, sf_dir).select("doc_id", "body"))


for name, check in C.CHECKS.items():
    check_query(name, lambda docs, check=check: C.run(check, docs))
check_query("quote_style_consistency", C.quote_style)
check_query("english_spelling_consistency", C.spelling)
check_query("acronym_definition", C.acronyms)


def bundle(*names: str):
    """The checks' rows as one table of (doc_id, check_id, seq), from one scan."""
    return lambda spark, sf_dir: C.findings(manuscripts(spark, sf_dir).select("doc_id", "body"), *names).select("doc_id", "check_id", F.col("seq").cast("long").alias("seq"))


TYPOGRAPHY = ("typo_en_dash", "typo_number_unit", "typo_percent_degree")
GRAMMAR = ("acronym_definition", "en_dash_ranges", "nonbreaking_space_units", "no_space_percent_degree", "double_spaces", "punctuation_spacing", "quote_style_consistency", "english_spelling_consistency")
Q["typography_all"], Q["syntax_grammar_all"] = bundle(*TYPOGRAPHY), bundle(*GRAMMAR)


def oracle(name: str, rows: str, rules: int, width: int, correct: str, detail: str, kind: str = "null::varchar", key: str = "found", pre: str = "", found: str = "found") -> None:
    O[name] = f"""with {D.BODY}{pre}
select doc_id, '{name}' as check_id, seq, s as pos, {kind} as kind, {found} as found, {correct} as correct, {D.snippet(width)} as snippet, {detail} as detail
from ({D.capped(rows, rules, key=key)})"""


CLEAN = f", b as (select doc_id, body, {D.blanked('body', '(?i)' + C.DOI_PATH)} as b1 from d), c as (select doc_id, body, {D.blanked('b1', C.BRACKETS)} as c from b)"
DASHES = "case k when 0 then 'use en-dash for range: ' else 'use en-dash instead of double hyphen: ' end || found"
DOUBLE = D.spans("c", "c", r"(\d)\s*--\s*(\d)", 1, 2, "body")
# A digit run's neighbours are tested beside the match: the first digit follows no word character, the last none either.
oracle("en_dash_ranges", D.spans("c", "c", r"\b(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)\b", 0, 2, "body") + " union all " + DOUBLE, 2, 35, "g1 || '–' || g2", DASHES, pre=CLEAN)
oracle("typo_en_dash", f"select * from ({D.spans('c', 'c', r'(\d+)-(\d+)', 0, 2, 'body')}) where not regexp_matches(bef, '[\\w–-]') and not regexp_matches(aft, '[\\w/–-]') and not regexp_matches(aft40, '^\\.\\d') union all {DOUBLE}", 2, 30, "g1 || '–' || g2", DASHES, pre=CLEAN)


def units(name: str, alternatives: str, width: int, sep: str, detail: str) -> None:
    # The lookahead after the unit makes the engine try shorter units; longest-first with a following non-alphanumeric does the same.
    rows = D.spans("d", "body", rf"\b(\d+(?:\.\d+)?)({alternatives})\b", 0, 2)
    oracle(name, rows, 1, width, f"g1 || '{sep}' || g2", f"'{detail}: ' || found")


units("typo_number_unit", C.TYPOGRAPHY_UNITS, 30, " ", "add space between number and unit")
units("nonbreaking_space_units", C.GRAMMAR_UNITS, 35, "\u00a0", "no space between number and unit")
oracle("typo_percent_degree", f"select * from ({D.spans('d', 'body', r'\b(\d+(?:\.\d+)?)(%)', 0, 2)}) where regexp_matches(aft, '[A-Za-z]') union all select * from ({D.spans('d', 'body', r'\b(\d+°)', 1, 1)}) where not regexp_matches(aft, '[CFK\\s°\\d]')", 2, 30, "null::varchar", "case k when 0 then 'percent sign directly followed by a letter' else 'degree sign without unit' end")
oracle("no_space_percent_degree", D.spans("d", "body", r"\b(\d+(?:\.\d+)?)\s+(%)", 0, 2) + " union all " + D.spans("d", "body", r"\b(\d+(?:\.\d+)?)\s+(°(?:[CFK]?))", 1, 2), 2, 35, "g1 || g2", "'remove space: ' || found")
_A = f"select * from ({D.spans('d', 'body', ' +[,;]', 0)}) where regexp_matches(bef, '[a-zA-Z0-9]')"
_B = f"select * from ({D.spans('d', 'body', ',', 1)}) where regexp_matches(aft40, '^[a-zA-Z][a-z]')"
_C = f"select * from ({D.spans('d', 'body', ' {2,}', 2)}) where regexp_matches(bef, '[,.;]') and regexp_matches(aft, '[A-Za-z]')"
_KIND = "['space_before_comma', 'no_space_after_comma', 'multiple_spaces_after_punct'][k + 1]"
oracle("punctuation_spacing", f"{_A} union all {_B} union all {_C}", 3, 35, "null::varchar", f"replace({_KIND}, '_', ' ')", _KIND, "k, s // 150")
_RUNS = f"select * from ({D.spans('x', 'c', ' {4,}', 0, 0, 'body')}) where bef <> '' and not regexp_matches(bef, '[\\n\\r\\t ]') and aft <> '' and not regexp_matches(aft, '[\\n\\r\\t ]')"
oracle("double_spaces", _RUNS, 1, 35, "null::varchar", "''", key="", found="(e - s) || ' consecutive space(s)'", pre=f", x as (select doc_id, body, regexp_replace(body, {D.lit(C.BRACKETS)}, ' ', 'g') as c from d)")
O["quote_style_consistency"] = f"""with {D.BODY}, k as (select doc_id, case when contains(body, '"') and regexp_matches(body, '[“”]') then 'mixed_double_quotes'
  when regexp_matches(body, '[‘’]') and contains(body, '"') then 'mixed_single_and_straight_double' end as kind from d)
select doc_id, 'quote_style_consistency' as check_id, kind from k where kind is not null"""
_PAIRS = "(values " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(C.SPELLINGS)) + ") p(i, american, british)"


def _first(word: str) -> str:
    start = f"length(string_split_regex(body, '(?i)\\b' || {word} || '\\b')[1])"
    return D.snippet(35, "body", start, f"({start} + length({word}))")


O["english_spelling_consistency"] = rf"""with {D.BODY}, b as (
  select *, row_number() over (partition by doc_id order by i) as seq from d cross join {_PAIRS}
  where regexp_matches(body, '(?i)\b' || american || '\b') and regexp_matches(body, '(?i)\b' || british || '\b') qualify seq <= 25)
select doc_id, 'english_spelling_consistency' as check_id, seq, american, british, {_first('american')} as am_snippet, {_first('british')} as br_snippet from b"""
_SKIP = "(" + ", ".join(D.lit(a) for a in C.SKIP_ACRONYMS) + ")"
O["acronym_definition"] = rf"""with {D.BODY},
paren as (select doc_id, s, e, g1, list_filter(flatten(list_transform(string_split_regex(substr(o, greatest(s - 600, 0) + 1, least(s, 600)), '\s+'), lambda w: string_split(w, '-'))), lambda w: true) as raw
  from ({D.spans("d", "body", r"\(([A-Z]{3,})\)", 0, 1)}) where g1 not in {_SKIP}),
clean as (select *, list_filter(list_transform(raw, lambda w: trim(w, '.,;:"''()')), lambda w: regexp_matches(w, '^\p{{L}}')) as w from paren),
tail as (select *, array_to_string(list_transform(w[greatest(len(w) - length(g1) - 14, 1):], lambda x: upper(x[1])), '') as initials from clean),
defs as (select doc_id, g1, s from tail where contains(initials, g1) union all
  select doc_id, g1, s from ({D.spans("d", "body", r"([A-Z]{3,})\s+\([a-zA-Z][a-zA-Z0-9\s\-,./']{3,80}\)", 0, 1)}) where g1 not in {_SKIP} and not regexp_matches(bef, '[\p{{L}}\p{{N}}_]')),
uses as (select u.* from ({D.spans("d", "body", r"([A-Z]{3,})", 0, 1)}) u where not regexp_matches(bef, '[\p{{L}}\p{{N}}_]') and not regexp_matches(aft, '[\p{{L}}\p{{N}}_]') and g1 not in {_SKIP} and not exists (select 1 from paren p where p.doc_id = u.doc_id and p.s <= u.s and u.s < p.e)),
first as (select * from uses qualify row_number() over (partition by doc_id, g1 order by s) = 1),
judged as (select f.*, (select min(s) from defs x where x.doc_id = f.doc_id and x.g1 = f.g1) as def_at from first f)
select doc_id, 'acronym_definition' as check_id, row_number() over (partition by doc_id order by s) as seq, s as pos, g1 as found, case when def_at is null then 'never_defined' else 'used_before' end as kind, {D.snippet(35)} as snippet
from judged where def_at is null or def_at > s qualify seq <= 25"""
for name, parts in (("typography_all", TYPOGRAPHY), ("syntax_grammar_all", GRAMMAR)):
    O[name] = " union all ".join(f"select doc_id, check_id, {'1' if p == 'quote_style_consistency' else 'seq'}::bigint as seq from ({O[p]})" for p in parts)


# Primitives.
def match_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manuscripts(spark, sf_dir).select("doc_id", F.explode(T.spans(F.col("full_text"), T.pattern(r"\[(\d+)[^\]]*\]"), 1)).alias("s"))
    return m.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.found").alias("found"), F.col("s.g1").alias("number"))


Q["match_spans"] = match_spans
O["match_spans"] = f'with {D.BODY} select doc_id, s as start, e as "end", found, g1 as number from ({D.spans("d", "full_text", r"\[(\d+)[^\]]*\]", 0, 1)})'


def page_parts(text: str, size: int = 400):
    """Pages of a fixed number of characters, as an array; the fixture of page lookups."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size).cast("int") - 1, F.lit(0))), lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))


def char_to_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manuscripts(spark, sf_dir).withColumn("pages", page_parts("full_text"))
    m = m.select("doc_id", T.page_offsets(F.col("pages")).alias("offsets"), T.spans(F.array_join("pages", "\n"), T.pattern(r"\[\d+\]")).alias("s"))
    m = m.select("doc_id", "offsets", F.explode("s").alias("s"))
    return m.select("doc_id", F.col("s.start").alias("pos"), T.char_to_page(F.col("offsets"), F.col("s.start")).alias("page"))


Q["char_to_page"] = char_to_page
_PAGES = "list_transform(range(0, greatest(ceil(length(full_text) / 400.0)::bigint, 1)), lambda i: substr(full_text, i * 400 + 1, 400))"
O["char_to_page"] = f"""with {D.BODY}, p as (select doc_id, array_to_string({_PAGES}, chr(10)) as t from d)
select doc_id, s as pos, s // 401 + 1 as page from ({D.spans("p", "t", r"\[\d+\]")})"""


def simple(name: str, columns, sql: str, source: str = "d") -> None:
    """A query of column expressions over manuscripts and its oracle over the same relation."""
    Q[name] = lambda spark, sf_dir: manuscripts(spark, sf_dir).select("doc_id", *columns())
    O[name] = f"with {D.BODY} select doc_id, {sql} from {source}"


simple("snippet", lambda: [T.snippet(F.col("full_text"), F.instr("full_text", "Network") - 1, F.instr("full_text", "Network") + 6, 35).alias("snippet")], D.snippet(35, "full_text", "(instr(full_text, 'Network') - 1)", "(instr(full_text, 'Network') + 6)") + " as snippet")
simple("blank_citations", lambda: [C.without_citations(F.col("full_text")).alias("blanked")], f"{D.blanked('b1', C.BRACKETS)} as blanked", f"(select doc_id, {D.blanked('full_text', '(?i)' + C.DOI_PATH)} as b1 from d)")
simple("body_text", lambda: ["body"], "body")
simple("word_count", lambda: [F.size(T.words(F.col("body"))).cast("long").alias("words")], r"len(list_filter(string_split_regex(body, '\s+'), lambda w: w <> ''))::bigint as words")
simple("mask_superscripts", lambda: [F.md5(T.mask_superscripts(F.concat("body", F.lit(" Fig. 4¹ H₂O x⁹"))).cast("binary")).alias("masked")], "md5(regexp_replace(body || ' Fig. 4¹ H₂O x⁹', '[⁰¹²³⁴-⁹₀-₉]', '·', 'g')) as masked")


def violation_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = manuscripts(spark, sf_dir).select("doc_id", F.explode(T.spans(F.col("full_text"), T.pattern(r"\w+"))).alias("s")).select("doc_id", F.lit(0).alias("k"), F.col("s.start").alias("start"), F.col("s.found").alias("found"))
    return C.capped(docs, 1).select("doc_id", "seq", F.col("start").alias("pos"), "found")


Q["violation_cap"] = violation_cap
O["violation_cap"] = f"with {D.BODY} select doc_id, seq, s as pos, found from ({D.capped(D.spans('d', 'full_text', '[\\p{L}\\p{N}_]+'), 1, key='')})"
