"""A corpus checked end to end: all checks' violations to candidates with evidence, with their oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.operators import corpus as K
from folioscan.operators import numbering as N
from folioscan.operators import references as R
from folioscan.operators import verify as V
from folioscan.sources.manuscripts import manuscripts, select

from . import duck as D
from . import numbering_queries as NQ
from . import reference_queries as RQ
from . import text_queries as TQ

Q, O = {}, {}
# Captions and boxes of numbered figures and tables, numbers repeated.
CAPTIONED = "select l_orderkey as doc_id, cast(l_linenumber % 5 as int) as number, l_partkey * 100000 + l_suppkey * 10 + l_linenumber as pos, case when l_partkey % 11 = 0 then null else concat('Caption ', cast(l_partkey as varchar(12))) end as caption_text from lineitem"
BOXED = NQ.BOXES.replace("select l_orderkey as doc_id,", "select l_orderkey as doc_id, cast(l_linenumber as int) as number,")
FAILED = "select o_orderkey as doc_id, 'equation_punctuation' as check_id, concat('order ', cast(o_custkey as varchar(12))) as detail from orders where o_custkey > 0"
TEXT = tuple(n for n in TQ.GRAMMAR if n not in ("acronym_definition", "quote_style_consistency", "english_spelling_consistency"))


def violations(spark, sf_dir):
    figures, tables = (select(spark, sf_dir, q, "lineitem") for q in (NQ.FIGURES, NQ.TABLES))
    captions, boxes = (select(spark, sf_dir, q, "lineitem") for q in (CAPTIONED, BOXED))
    m = manuscripts(spark, sf_dir)
    offsets = m.select("doc_id", F.sequence(F.lit(0), F.length("full_text"), F.lit(400)).alias("offsets"))
    parts = [K.caption_violations(boxes, captions, above) for above in (False, True)]
    parts += [K.sequence_violations(rows, kind) for rows, kind in ((figures, "figure"), (tables, "table"))]
    parts += [K.order_violations(rows, kind, ["l_partkey", "l_suppkey"]) for rows, kind in ((figures, "figure"), (tables, "table"))]
    parts.append(K.part_violations(select(spark, sf_dir, NQ.CAPTIONS, "part")))
    parts.append(K.text_violations(m.select("doc_id", "body"), offsets, *TQ.GRAMMAR))
    parts.append(K.citation_violations(RQ.bidirectional_match(spark, sf_dir)))
    gaps, comma = N.equation_gaps(select(spark, sf_dir, NQ.EQUATIONS, "lineitem")), N.equation_punctuation(select(spark, sf_dir, NQ.CONTEXTS, "lineitem"))
    parts.append(K.with_failures(K.equation_violations(gaps, comma, NQ.in_text_reference_consistency(spark, sf_dir)), select(spark, sf_dir, FAILED, "orders")))
    return parts


def corpus_candidates(spark, sf_dir):
    c = K.flattened(violations(spark, sf_dir))
    text = F.array_join(F.transform("evidence", lambda e: F.concat(e["id"], F.lit("="), e["content"])), "|")
    return c.select("doc_id", "candidate_id", "check_id", "page", "skip_verifier", text.alias("evidence"))


Q["corpus_candidates"] = corpus_candidates


def _rows(check: str, seq: str, page: str, detail: str, shape: str, source: str) -> str:
    return f"select doc_id, {check} as check_id, ({seq})::bigint as seq, ({page})::int as page, {detail} as detail, {shape} as shape from {source}"


def _y(c: str) -> str:
    return f"printf('%.1f', {c}::double)"


def _or(c: str, default: str = "?") -> str:
    return f"coalesce(({c})::varchar, '{default}')"


def _list(c: str, quote: str = "") -> str:
    q = quote.replace("'", "''")
    return f"case when {c} = '' then '[]' else '[{q}' || replace({c}, ',', '{q}, {q}') || '{q}]' end"


_NONE = "'|context=|found='"
_LAST = f"(select doc_id, number, caption_text from ({CAPTIONED}) qualify row_number() over (partition by doc_id, number order by pos desc) = 1)"
_BOX = f"(select * from ({BOXED}) b left join {_LAST} c using (doc_id, number))"
_PARTS = [
    _rows("'figure_caption_below'", "number", "caption_page", f"'Figure ' || number || ' (page ' || caption_page || '): caption bottom (y=' || {_y('caption_y1')} || ') is placed above the image top (y=' || {_y('image_y0')} || ').'",
          f"'|figure_number=' || number || '|caption_text=' || coalesce(caption_text, '') || '|caption_page=' || caption_page || '|image_y0=' || image_y0::double || '|caption_y1=' || caption_y1::double", f"{_BOX} where caption_page = image_page and caption_y1 < image_y0 - 15"),
    _rows("'table_caption_above'", "number", "caption_page", f"'Table ' || number || ' (page ' || caption_page || '): caption top (y=' || {_y('caption_y0')} || ') is below the table body top (y=' || {_y('body_y0')} || ').'",
          f"'|table_number=' || number || '|caption_text=' || coalesce(caption_text, '') || '|caption_page=' || caption_page || '|caption_y0=' || caption_y0::double || '|table_body_y0=' || body_y0::double", f"{_BOX} where caption_y0 > body_y0 + 15"),
]
for _k in ("figure", "table"):
    _what = ", ".join(f"case when {c} <> '' then '{w} {_k} number(s): ' || {_list(c)} end" for w, c in (("Missing", "missing_numbers"), ("Duplicate", "duplicate_numbers")))
    _PARTS.append(_rows(f"'{_k}_sequential_numbering'", "1", "null", f"'{_k.title()} numbering is NOT sequential. ' || concat_ws('; ', {_what}) || '.'", "null", f"({NQ.O[f'{_k}_sequential_numbering']}) where not passed"))
    _PARTS.append(_rows(f"'{_k}_chronological_order'", "number", "page", f"'{_k.title()} ' || number || ' is first mentioned on page ' || page || ', before {_k.title()} ' || previous_number || ' (first mentioned on page ' || previous_page || ').'",
                        f"'|object_type={_k}|object_number=' || number || '|first_mention_page=' || page || '|previous_object=' || previous_number || '|previous_page=' || previous_page", f"({NQ.O[f'{_k}_chronological_order']})"))
_FOUND, _MISSED = _list("found_parts", "'"), _list("missing_parts", "'")
_PARTS.append(_rows("'figure_parts_mention'", "number", "null", f"case when starts_at_a then 'Figure ' || number || ': sub-part label(s) ' || {_MISSED} || ' are missing from the caption. Found: ' || {_FOUND} || '.' else 'Figure ' || number || ': sub-part labels do not start from ''(a)''. Found: ' || {_FOUND} || '.' end",
                    f"'|figure_number=' || number || '|found_parts=' || {_FOUND} || '|missing_parts=' || {_MISSED}", f"({NQ.O['figure_parts_mention']})"))
for _c in TEXT:
    _PARTS.append(_rows("check_id", "seq", "pos // 400 + 1", "detail", "'|context=' || snippet || '|found=' || found", f"({TQ.O[_c]})"))
_PARTS.append(_rows("check_id", "seq", "pos // 400 + 1", "'''' || found || case kind when 'never_defined' then ''' is never defined -- add ''(Full Name)'' at its first use.' else ''' is used (char ' || pos || ') before its definition. Define at first occurrence.' end", "'|acronym=' || found || '|first_occurrence=' || snippet", f"({TQ.O['acronym_definition']})"))
_PARTS.append(_rows("check_id", "1", "null", "case kind " + " ".join(f"when '{k}' then {D.lit(v)}" for k, v in K.QUOTES.items()) + " end", _NONE, f"({TQ.O['quote_style_consistency']})"))
_PARTS.append(_rows("check_id", "seq", "null", "'Mixed spelling: ''' || american || ''' (American) and ''' || british || ''' (British) both appear. Standardize to one variant.'", _NONE, f"({TQ.O['english_spelling_consistency']})"))
_PARTS.append(_rows("'bidirectional_match'", "seq", "page", "case type when 'missing_from_refs' then '[' || number || '] is cited in the text but has no corresponding entry in the reference list.' else 'Reference [' || number || '] appears in the reference list but is never cited in the body text.' end",
                    f"'|ref_id=' || number || '|page=' || {_or('page')} || '|context=|suggestion=' || case type when 'missing_from_refs' then 'Add a reference entry for [' || number || '] in the reference list.' else 'Either cite reference [' || number || '] in the text or remove it from the reference list.' end", f"({RQ.O['bidirectional_match']})"))
_JUMP = "' missing — sequence jumps from (' || (number - 1) || ') to (' || (upto + 1) || ').'"
_PARTS += [
    _rows("'equation_sequential_numbering'", "seq", "page", f"case when number = upto then 'Equation (' || number || ') is' else 'Equations (' || number || ')–(' || upto || ') are' end || {_JUMP}", _NONE, f"({NQ.O['equation_sequential_numbering']})"),
    _rows("'equation_punctuation'", "seq", "null", r"""'Missing comma after Equation ' || label || ' — the sentence continues with "' || regexp_extract(evidence, '^(\S+)', 1) || '..." which requires a comma at the end of the equation.'""", _NONE, f"({NQ.O['equation_punctuation']})"),
    _rows("'in_text_reference_consistency'", "seq", "page", """'Inconsistent citation style: found "' || found || '" (style: "' || style || '") instead of dominant style "' || dominant || '".'""", _NONE, f"({NQ.O['in_text_reference_consistency']})"),
]
_PARTS.append(_rows("check_id", "0", "null", "detail", _NONE, f"({FAILED}) where doc_id not in (select doc_id from ({NQ.O['equation_punctuation']}))"))
_DIM = "(values " + ", ".join(f"({i}, {D.lit(r[0])}, {str(r[3]).lower()})" for i, r in enumerate(V.RULES)) + ") dim(rule_no, check_id, skip_verifier)"
O["corpus_candidates"] = f"""with v as ({" union all ".join(f"select * from ({p})" for p in _PARTS)}),
n as (select v.*, skip_verifier, row_number() over (partition by doc_id order by rule_no, check_id, seq, detail) as i from v join {_DIM} using (check_id))
select doc_id, replace(upper(substr(check_id, 1, 6)), '_', '') || '-' || case when i < 100 then lpad(i::varchar, 3, '0') else i::varchar end as candidate_id, check_id, page, skip_verifier,
  case when shape is null then 'detail=' || detail else 'violation_detail=' || detail || shape end as evidence from n"""
