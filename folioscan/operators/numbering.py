"""Checks over numbered entities (figures, tables, equations) and their positions.

All are relational: one shuffle by document, then aggregates or windows over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.text import around, char_to_page, pattern, spans

TOLERANCE, EQUATION_CAP, STYLE_CAP = 15, 20, 10


def joined(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


def sequential(rows: DataFrame) -> DataFrame:
    """(doc_id, number) -> doc_id, found_sequence, missing_numbers, duplicate_numbers, passed. Rows without a number are left out."""
    found = F.sort_array(F.collect_list(F.col("number").cast("int")))
    g = rows.where("number is not null").groupBy("doc_id").agg(found.alias("found"))
    g = g.withColumn("one", F.array_distinct("found"))
    missing = F.when(F.array_max("found") >= 1, F.array_except(F.sequence(F.lit(1), F.greatest(F.array_max("found"), F.lit(1))), "one")).otherwise(F.array().cast("array<int>"))
    # The list is sorted, so a number is repeated where it equals its neighbour.
    again = F.array_distinct(F.filter("found", lambda x, i: (i > 0) & (F.get("found", i - 1) == x)))
    g = g.select("doc_id", "found", missing.alias("missing"), again.alias("again"))
    return g.select("doc_id", joined(F.col("found")).alias("found_sequence"), joined(F.col("missing")).alias("missing_numbers"), joined(F.col("again")).alias("duplicate_numbers"), ((F.size("missing") == 0) & (F.size("again") == 0)).alias("passed"))


def chronological(rows: DataFrame, tie: list[str]) -> DataFrame:
    """(doc_id, number, first_mention_page) -> rows first mentioned on an earlier page than the entity before them by number."""
    w = Window.partitionBy("doc_id").orderBy("number", *tie, "first_mention_page")
    r = rows.where("number is not null and first_mention_page is not null").withColumn("previous_page", F.lag("first_mention_page").over(w)).withColumn("previous_number", F.lag("number").over(w))
    return r.where("first_mention_page < previous_page").select("doc_id", "number", F.col("first_mention_page").alias("page"), "previous_number", "previous_page")


def _sides(above: bool) -> tuple[Column, Column]:
    """(whether a caption's positions are unknown or on different pages, whether it is on the wrong side)."""
    if above:
        return F.col("caption_y0").isNull() | F.col("body_y0").isNull(), F.col("caption_y0") > F.col("body_y0") + TOLERANCE
    unknown = F.col("caption_y1").isNull() | F.col("image_y0").isNull() | ~F.col("caption_page").eqNullSafe(F.col("image_page"))
    return unknown, F.col("caption_y1") < F.col("image_y0") - TOLERANCE


def misplaced(rows: DataFrame, above: bool) -> DataFrame:
    """The rows of captions on the wrong side; see caption_side."""
    unknown, bad = _sides(above)
    return rows.where(~unknown & bad)


def caption_side(rows: DataFrame, above: bool) -> DataFrame:
    """Captions on the wrong side. above (tables): caption_y0 beyond body_y0; else (figures): caption_y1 before image_y0 on the same page; both with a tolerance.

    Returns for each document: doc_id, violations, skipped (rows whose positions are unknown or on different pages), passed.
    """
    unknown, bad = _sides(above)
    n = F.count(F.when(~unknown & bad, 1))
    return rows.groupBy("doc_id").agg(n.alias("violations"), F.count(F.when(unknown, 1)).alias("skipped"), (n == 0).alias("passed"))


def figure_parts(rows: DataFrame) -> DataFrame:
    """(doc_id, number, caption_text) -> figures whose part letters don't run from a without a gap: found_parts, missing_parts, starts_at_a."""
    letters = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("caption_text", F.lit(r"\(([a-zA-Z])\)"), F.lit(1)), F.lower)))
    r = rows.select("doc_id", "number", letters.alias("p")).where("size(p) > 0")
    span = F.ascii(F.element_at("p", -1)) - F.ascii(F.element_at("p", 1)) + 1
    r = r.where(F.array_contains("p", "a") | ((F.size("p") >= 2) & (span == F.size("p"))))
    expected = F.transform(F.sequence(F.lit(97), F.ascii(F.element_at("p", -1))), lambda c: F.char(c))
    starts = F.element_at("p", 1) == "a"
    r = r.withColumn("missing", F.when(starts, F.array_except(expected, "p")).otherwise(F.array().cast("array<string>"))).where(~starts | (F.size("missing") > 0))
    return r.select("doc_id", "number", F.array_join("p", ",").alias("found_parts"), F.array_join("missing", ",").alias("missing_parts"), starts.alias("starts_at_a"))


def equation_gaps(rows: DataFrame) -> DataFrame:
    """(doc_id, number, page_number, pos) -> gaps between adjacent numbers of documents with three or more: number (first missing), upto (last missing), page, seq; EQUATION_CAP each."""
    one = rows.where("number >= 1").groupBy("doc_id", "number").agg(F.min_by("page_number", F.struct("pos", "page_number")).alias("page"))
    doc = Window.partitionBy("doc_id")
    g = one.withColumn("n", F.count("*").over(doc)).withColumn("after", F.lead("number").over(doc.orderBy("number"))).where("n >= 3 and after - number >= 2")
    g = g.withColumn("seq", F.row_number().over(doc.orderBy("number"))).where(F.col("seq") <= EQUATION_CAP)
    return g.select("doc_id", "seq", (F.col("number") + 1).alias("number"), (F.col("after") - 1).alias("upto"), "page")


def equation_punctuation(rows: DataFrame) -> DataFrame:
    """(doc_id, label, pos, context_before, context_after) -> equations that a sentence goes on from without a comma; EQUATION_CAP each."""
    before, after = (F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "") for c in ("context_before", "context_after"))
    r = rows.withColumn("a", after).where(F.col("a").rlike(pattern(r"^(?:where|with|in\s+which|such\s+that)\b", "i")) & ~before.rlike("[,.]$"))
    r = r.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "label", "a"))).where(F.col("seq") <= EQUATION_CAP)
    return r.select("doc_id", "seq", "label", F.substring("a", 1, 60).alias("evidence"))


# Call-out styles, most specific first. The fourth also matches what the second does and is merged into it, which counts such call-outs twice.
CALLOUTS = (("Equation (N)", r"\bEquation\s+\(\d+\)"), ("Eq. (N)", r"\bEq\.\s*\(\d+\)"), ("Eq (N)", r"\bEq\s+\(\d+\)"), ("Eqs. (N)", r"\bEqs?\.\s*\(\d+\)"), ("eqn. (N)", r"\beqn\.\s*\(\d+\)"), ("eqn (N)", r"\beqn\s+\(\d+\)"))


def callout_styles(docs: DataFrame) -> DataFrame:
    """(doc_id, full_text, offsets) -> call-outs that aren't in the document's most common style: seq, style, dominant, pos, page, found, evidence.

    STYLE_CAP for a minority style, EQUATION_CAP for a document; of equally common styles the first listed dominates.
    """
    text = F.col("full_text")
    found = F.array(*(F.struct(F.lit(i).alias("k"), spans(text, pattern(p, "i")).alias("s")) for i, (_, p) in enumerate(CALLOUTS)))
    rows = docs.select("doc_id", "full_text", "offsets", F.explode(found).alias("f")).select("doc_id", F.col("f.k").alias("k"), F.posexplode("f.s").alias("i", "s"), "full_text", "offsets")
    evidence = F.trim(F.replace(around(text, F.col("s.start"), F.col("s.start"), 40), F.lit("\n"), F.lit(" ")))
    rows = rows.select("doc_id", "k", F.col("s.start").alias("pos"), char_to_page(F.col("offsets"), F.col("s.start")).alias("page"), F.col("s.found").alias("found"), evidence.alias("evidence"))
    has = F.max(F.when(F.col("k") == 1, 1)).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("style", F.when((F.col("k") == 3) & has.isNotNull(), 1).otherwise(F.col("k")))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "style")))
    rows = rows.withColumn("dominant", F.max(F.struct("n", (-F.col("style")).alias("style"))).over(Window.partitionBy("doc_id"))["style"] * -1).where("style <> dominant")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "style").orderBy("k", "pos"))).where(F.col("r") <= STYLE_CAP)
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("style", "k", "pos"))).where(F.col("seq") <= EQUATION_CAP)
    names = F.array(*(F.lit(n) for n, _ in CALLOUTS))
    return rows.select("doc_id", "seq", F.element_at(names, F.col("style") + 1).alias("style"), F.element_at(names, F.col("dominant") + 1).alias("dominant"), "pos", "page", "found", "evidence")


def label_number(label: Column) -> Column:
    """The integer of an equation label without its leading letter (and dot) or trailing letter; null if it isn't one."""
    return F.regexp_replace(F.regexp_replace(label, r"^[A-Za-z]\.?", ""), r"[A-Za-z]$", "").try_cast("int")


def equation_labels(words: DataFrame) -> DataFrame:
    """Words (doc_id, page_number, page_w, page_h, block_no, line_no, text, x0, y0, x1, y1) -> equation labels at the ends of lines: number, label, page_number, x0, y0.

    The last word of a line, right of 35 % of the page and clear of its margins, wholly in parentheses (or the glyphs that
    stand for them), not a year, at least 10 points from the word before, and numbered 1 to 200 if numbered at all.
    """
    line = Window.partitionBy("doc_id", "page_number", "block_no", "line_no")
    w = words.withColumn("r", F.row_number().over(line.orderBy(F.col("x0").desc(), F.col("text")))).withColumn("left", F.lead("x1").over(line.orderBy(F.col("x0").desc(), F.col("text"))))
    w = w.where("r = 1 and x0 > 0.35 * page_w and y0 >= 50 and y1 <= page_h - 50").where(~F.col("text").rlike(r"^\((?:19|20)\d{2}\)$"))
    w = w.withColumn("label", F.regexp_extract("text", "^[(ð]([A-Za-z]?\\d+[A-Za-z]?(?:\\.\\d+)?)[)Þ]$", 1)).where("label <> ''")
    w = w.where("left is null or x0 - left >= 10").withColumn("number", label_number(F.col("label"))).where("number is null or number between 1 and 200")
    return w.select("doc_id", "number", F.col("text").alias("label"), "page_number", "x0", "y0")


def equation_dedupe(rows: DataFrame) -> DataFrame:
    """First equation of each number by page and y0; those without a number all stay."""
    first = F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("page_number", "y0"))
    return rows.withColumn("_first", first).where("number is null or _first = 1").drop("_first")


def equation_context(rows: DataFrame, width: int = 400) -> DataFrame:
    """(doc_id, label, page_text) -> context_before and context_after: up to width characters beside the label's last occurrence, trimmed; empty if it has none."""
    at = F.length("page_text") - F.instr(F.reverse("page_text"), F.reverse("label")) - F.length("label") + 1
    found = F.contains("page_text", "label")
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    before = F.substring(F.col("page_text"), F.greatest(at - width, F.lit(0)) + 1, F.least(at, F.lit(width)))
    after = F.substring(F.col("page_text"), at + F.length("label") + 1, F.lit(width))
    return rows.select("doc_id", "label", F.when(found, strip(before)).otherwise("").alias("context_before"), F.when(found, strip(after)).otherwise("").alias("context_after"))
