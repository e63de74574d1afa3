"""From the findings of all checks of a corpus to candidates with evidence, in one plan.

A violation is (doc_id, check_id, seq, page, detail, raw): raw maps the names of what its check found to texts. Each check
gives violations by a projection, so flattening them shuffles nothing; numbering them is one shuffle by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numbering as N
from . import text_checks as C
from . import verify as V

# What a check's evidence shows after the detail, in order, and what stands for a part that isn't known.
FIGURE = (("figure_number", "?"), ("caption_text", ""), ("caption_page", "?"), ("image_y0", "?"), ("caption_y1", "?"))
TABLE = (("table_number", "?"), ("caption_text", ""), ("caption_page", "?"), ("caption_y0", "?"), ("table_body_y0", "?"))
ORDER = (("object_type", "?"), ("object_number", "?"), ("first_mention_page", "?"), ("previous_object", "?"), ("previous_page", "?"))
PARTS = (("figure_number", "?"), ("found_parts", "[]"), ("missing_parts", "[]"))
ACRONYM = (("acronym", ""), ("first_occurrence", ""))
GENERIC = (("context", ""), ("found", ""))
REFERENCE = (("ref_id", "?"), ("page", "?"), ("context", ""), ("suggestion", ""))
SHAPES = {"figure_caption_below": FIGURE, "table_caption_above": TABLE, "figure_chronological_order": ORDER, "table_chronological_order": ORDER, "figure_parts_mention": PARTS, "acronym_definition": ACRONYM}
SHAPES |= dict.fromkeys(("style_compliance", "bidirectional_match", "metadata_completeness", "doi_url", "sequential_ordering", "field_consistency"), REFERENCE)
#: Checks that fail as a whole: their detail is all the evidence.
WHOLE = ("figure_sequential_numbering", "table_sequential_numbering")
# Details of quote styles.
QUOTES = {
    "mixed_double_quotes": 'Both straight double quotes (") and curly double quotes (“”) found in the document. Use one style consistently throughout.',
    "mixed_single_and_straight_double": 'Curly single quotes (‘’) and straight double quotes (") found together. Unify quote style throughout the document.',
}


def said(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by its value; null values are ?."""
    parts = []
    for at, piece in enumerate(template.replace("{", "}").split("}")):
        parts.append(F.coalesce(values[piece].cast("string"), F.lit("?")) if at % 2 else F.lit(piece))
    return F.concat(*parts)


def violations(rows: DataFrame, check_id: str | Column, seq: Column, page: Column | None, detail: Column, /, **raw: Column) -> DataFrame:
    known = F.map_from_arrays(F.array(*map(F.lit, raw)), F.array(*(v.cast("string") for v in raw.values()))) if raw else F.create_map().cast("map<string,string>")
    check = F.lit(check_id) if isinstance(check_id, str) else check_id
    return rows.select("doc_id", check.alias("check_id"), seq.cast("long").alias("seq"), (F.lit(None) if page is None else page).cast("int").alias("page"), detail.alias("detail"), known.alias("raw"))


def listed(joined: Column, quote: str = "") -> Column:
    """Comma-joined values as a bracketed list."""
    return F.when(joined == "", "[]").otherwise(F.concat(F.lit(f"[{quote}"), F.replace(joined, F.lit(","), F.lit(f"{quote}, {quote}")), F.lit(f"{quote}]")))


def sequence_violations(rows: DataFrame, kind: str) -> DataFrame:
    """(doc_id, number) of figures or tables -> one violation of each document whose numbers have gaps or repeat."""
    bad = N.sequential(rows).where("not passed")
    what = [F.when(F.col(c) != "", F.concat(F.lit(f"{word} {kind} number(s): "), listed(F.col(c)))) for word, c in (("Missing", "missing_numbers"), ("Duplicate", "duplicate_numbers"))]
    detail = F.concat(F.lit(f"{kind.title()} numbering is NOT sequential. "), F.concat_ws("; ", *what), F.lit("."))
    return violations(bad, f"{kind}_sequential_numbering", F.lit(1), None, detail)


def order_violations(rows: DataFrame, kind: str, tie: list[str]) -> DataFrame:
    """(doc_id, number, first_mention_page) -> violations of those mentioned before their predecessor."""
    template = f"{kind.title()} {{n}} is first mentioned on page {{p}}, before {kind.title()} {{m}} (first mentioned on page {{q}})."
    n, p, m, q = map(F.col, ("number", "page", "previous_number", "previous_page"))
    return violations(N.chronological(rows, tie), f"{kind}_chronological_order", n, p, said(template, n=n, p=p, m=m, q=q), object_type=F.lit(kind), object_number=n, first_mention_page=p, previous_object=m, previous_page=q)


def caption_violations(rows: DataFrame, captions: DataFrame, above: bool) -> DataFrame:
    """Boxes (doc_id, number, caption_page, ...; see numbering.caption_side) -> violations of captions on the wrong side.

    captions(doc_id, number, pos, caption_text) are looked up by number; of repeated numbers the last pos counts.
    """
    last = captions.where("number is not null").groupBy("doc_id", "number").agg(F.max_by("caption_text", "pos").alias("caption_text"))
    bad = N.misplaced(rows, above).join(last, ["doc_id", "number"], "left")
    n, page = F.col("number"), F.col("caption_page")
    # A text of one decimal place, for the detail.
    y = {c: F.format_string("%.1f", F.col(c).cast("double")) for c in (("caption_y0", "body_y0") if above else ("caption_y1", "image_y0"))}
    places = {c: F.round(F.col(c).cast("double"), 2) for c in y}
    if above:
        detail = said("Table {n} (page {p}): caption top (y={c}) is below the table body top (y={b}).", n=n, p=page, c=y["caption_y0"], b=y["body_y0"])
        return violations(bad, "table_caption_above", n, page, detail, table_number=n, caption_text=F.col("caption_text"), caption_page=page, caption_y0=places["caption_y0"], table_body_y0=places["body_y0"])
    detail = said("Figure {n} (page {p}): caption bottom (y={c}) is placed above the image top (y={i}).", n=n, p=page, c=y["caption_y1"], i=y["image_y0"])
    return violations(bad, "figure_caption_below", n, page, detail, figure_number=n, caption_text=F.col("caption_text"), caption_page=page, image_y0=places["image_y0"], caption_y1=places["caption_y1"])


def part_violations(rows: DataFrame) -> DataFrame:
    """(doc_id, number, caption_text) -> violations of captions whose part letters have gaps."""
    n, found, missing = F.col("number"), listed(F.col("found_parts"), "'"), listed(F.col("missing_parts"), "'")
    gap = said("Figure {n}: sub-part label(s) {m} are missing from the caption. Found: {f}.", n=n, m=missing, f=found)
    start = said("Figure {n}: sub-part labels do not start from '(a)'. Found: {f}.", n=n, f=found)
    return violations(N.figure_parts(rows), "figure_parts_mention", n, None, F.when(F.col("starts_at_a"), gap).otherwise(start), figure_number=n, found_parts=found, missing_parts=missing)


def text_violations(docs: DataFrame, offsets: DataFrame, *names: str) -> DataFrame:
    """docs(doc_id, body), offsets(doc_id, offsets) of pages -> violations of the text checks. Checks of the text as a whole have no page."""
    found = C.findings(docs, *names).join(offsets, "doc_id", "left")
    check = F.col("check_id")
    quote, spelling, acronym = (check == c for c in ("quote_style_consistency", "english_spelling_consistency", "acronym_definition"))
    said_quotes = reduce(lambda out, x: out.when(F.col("kind") == x[0], x[1]), QUOTES.items(), F.when(F.lit(False), ""))
    mixed = said("Mixed spelling: '{a}' (American) and '{b}' (British) both appear. Standardize to one variant.", a=F.col("found"), b=F.col("correct"))
    undefined = F.when(F.col("kind") == "never_defined", said("'{a}' is never defined -- add '(Full Name)' at its first use.", a=F.col("found"))).otherwise(said("'{a}' is used (char {p}) before its definition. Define at first occurrence.", a=F.col("found"), p=F.col("pos")))
    detail = F.when(quote, said_quotes).when(spelling, mixed).when(acronym, undefined).otherwise(F.col("detail"))
    page = F.when(~quote & ~spelling & F.col("offsets").isNotNull(), F.greatest(F.size(F.filter("offsets", lambda o: o <= F.col("pos"))), F.lit(1)))
    other = ~quote & ~spelling
    return violations(found, check, F.col("seq"), page, detail, context=F.when(other, F.col("snippet")), found=F.when(other, F.col("found")), acronym=F.col("found"), first_occurrence=F.col("snippet"))


def citation_violations(matches: DataFrame) -> DataFrame:
    """references.bidirectional() -> violations."""
    n, missing = F.col("number"), F.col("type") == "missing_from_refs"
    detail = F.when(missing, said("[{n}] is cited in the text but has no corresponding entry in the reference list.", n=n)).otherwise(said("Reference [{n}] appears in the reference list but is never cited in the body text.", n=n))
    advice = F.when(missing, said("Add a reference entry for [{n}] in the reference list.", n=n)).otherwise(said("Either cite reference [{n}] in the text or remove it from the reference list.", n=n))
    return violations(matches, "bidirectional_match", F.col("seq"), F.col("page"), detail, ref_id=n, page=F.col("page"), suggestion=advice)


def equation_violations(gaps: DataFrame, punctuation: DataFrame, styles: DataFrame) -> DataFrame:
    """Rows of numbering's equation_gaps(), equation_punctuation() and callout_styles() -> violations."""
    n, m = F.col("number"), F.col("upto")
    jump = dict(a=n - 1, b=m + 1)
    one = said("Equation ({n}) is missing — sequence jumps from ({a}) to ({b}).", n=n, **jump)
    more = said("Equations ({n})–({m}) are missing — sequence jumps from ({a}) to ({b}).", n=n, m=m, **jump)
    word = F.regexp_extract("evidence", r"^(\S+)", 1)
    comma = said('Missing comma after Equation {l} — the sentence continues with "{w}..." which requires a comma at the end of the equation.', l=F.col("label"), w=word)
    style = said('Inconsistent citation style: found "{f}" (style: "{s}") instead of dominant style "{d}".', f=F.col("found"), s=F.col("style"), d=F.col("dominant"))
    out = violations(gaps, "equation_sequential_numbering", F.col("seq"), F.col("page"), F.when(n == m, one).otherwise(more))
    out = out.union(violations(punctuation, "equation_punctuation", F.col("seq"), None, comma))
    return out.union(violations(styles, "in_text_reference_consistency", F.col("seq"), F.col("page"), style))


def with_failures(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """violations, and one for each check in failed(doc_id, check_id, detail) that failed without giving any."""
    bare = failed.join(rows.select("doc_id", "check_id").distinct(), ["doc_id", "check_id"], "left_anti")
    return rows.union(violations(bare, F.col("check_id"), F.lit(0), None, F.coalesce("detail", F.lit(""))))


def evidence(candidates: DataFrame) -> DataFrame:
    """Candidates with evidence: array of (id, content) in the shape of their check. A part that isn't known has its default."""
    def shape(parts) -> Column:
        known = [F.struct(F.lit(name).alias("id"), F.coalesce(F.col("raw")[name], F.lit(default)).alias("content")) for name, default in parts]
        return F.array(F.struct(F.lit("violation_detail").alias("id"), F.col("detail").alias("content")), *known)

    out = F.when(F.col("check_id").isin(*WHOLE), F.array(F.struct(F.lit("detail").alias("id"), F.col("detail").alias("content"))))
    for parts in dict.fromkeys(SHAPES.values()):
        out = out.when(F.col("check_id").isin(*(c for c, p in SHAPES.items() if p == parts)), shape(parts))
    return candidates.withColumn("evidence", out.otherwise(shape(GENERIC)))


def flattened(parts: list[DataFrame]) -> DataFrame:
    """Candidates, numbered in the rules' order, with evidence, of all checks' violations. Empty in, empty out."""
    return evidence(V.candidates(reduce(DataFrame.union, parts)))


def shown(findings: DataFrame, raw: DataFrame) -> DataFrame:
    """What a report shows: a document's verified findings, or its raw violations if it has no finding; the same columns."""
    return findings.unionByName(raw.join(findings.select("doc_id").distinct(), "doc_id", "left_anti"))
