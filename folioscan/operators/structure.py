"""Structure of manuscripts from laid-out lines: fonts, headings, front matter, captions, reference layout.

Lines are rows (doc_id, page_number, line_no, text, size, bold, x0, y0, x1, y1, page_h, page_w) with line_no running over the
document. Line predicates are projections; what looks at neighbouring lines is a window over the document's lines.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscan.functions.text import let, pattern, spans, words

# Margins, ratios and word lists of the heading rules.
TOP, BOTTOM, LARGER, TOLERANCE = 60, 55, 1.15, 0.25
KNOWN_HEADINGS = "introduction conclusion references bibliography appendix abstract discussion methods results experiments preliminaries background theory overview declaration".split()
SMALL = "of the and to in for a an with by on at from as that we is are be or its about via using".split()
NOISE = r"^\s*(?:fig(?:ure)?\.?\s*(?:\d+|[ivxldcm]+)\b|table\s+(?:\d+|[ivxldcm]+)\b|eq(?:uation)?\.?\s*[\d(]|received\s+\d|accepted\s+\d|doi[\s:]|copyright\s|©\s*\d{4}|available\s+online|contents\s+lists|journal\s+homepage|www\.|https?://|e-?mail|\d+$)"
CODE = r"\b(?:while|do|then|else|end\s+if|end\s+for|end\s+while)\b"
TRANSITION = r"^\s*(?:First|Second|Third|Fourth|Fifth|Moreover|However|Furthermore|Specifically|Therefore|In\s+addition|Last),"
ROMAN = r"^(?:M{0,4}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3}))\.?$"
MATH = r"(?<=[\s\d])[-+](?=[\s\d])|(?<=[\s\d])=(?=[\s\d])|\b\d+\s*[=+]\s*\d+|[A-Za-z]\s*=\s*[A-Za-z]|[Ͱ-Ͽ←-⇿∀-⋿]|\\frac|\\sum|\\int|\bsin\b|\bcos\b|\btan\b|\d+\s*/\s*\d+"
# Fixed values.
CAPTION_VERBS = r"^(?:shows?|presents?|illustrates?|depicts?|compares?|lists?|gives?|provides?|reports?|displays?|summarizes?|contains?|includes?|describes?)"
BREAK = r"^\s*(?:\d+\.?\s+)?(?:introduction|keywords?|index\s+terms?|related\s+work|background|method|proposed|experiment|result|conclusion|discussion|references?|bibliography|acknowledgement)\s*$"
ABSTRACT_HEADER, ABSTRACT_INLINE = r"^\s*a(?:\s+b\s+s\s+t\s+r\s+a\s+c\s+t|bstract)\s*$", r"^\s*abstract\s*[—–\-:]\s*(.+)"
# Fixed values.
KEYWORD_LINE = r"(?:keywords?|index\s+terms?|key\s+words?)\s*[—–\-:\s]\s*(.+)"
# Fixed values.
AFFILIATION = r"@|\b(?:Univ(?:ersity)?|Dept\.?|Department|Institut(?:e|ion)?|School|Laborator(?:y|ies)|College|Center|Centre|Faculty|Division|Research|Academy|Technology|Corporation|Association|Member|Fellow|IEEE|ACM)\b|^\s*\d{5,}"


def body_font_size(spans_: DataFrame) -> DataFrame:
    """Spans (doc_id, page_number, pos, text, size) -> the half-point size with the most text on pages 2 to 5 (all pages of a one-page document); 10 if none. The first seen wins ties."""
    s = spans_.withColumn("pages", F.max("page_number").over(Window.partitionBy("doc_id"))).where("size >= 7 and (pages = 1 or page_number between 2 and 5)")
    g = s.groupBy("doc_id", F.bround(F.col("size") * 2).alias("half")).agg(F.sum(F.greatest(F.length(F.trim("text")), F.lit(1))).alias("weight"), F.min("pos").alias("first"))
    best = g.groupBy("doc_id").agg(F.max_by("half", F.struct("weight", (-F.col("first")).alias("f"))).alias("half"))
    return spans_.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce(F.col("half") / 2, F.lit(10.0)).alias("body_size"))


def modal_font_size(spans_: DataFrame) -> DataFrame:
    g = spans_.where("size > 4").groupBy("doc_id", F.bround("size").alias("size")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return g.groupBy("doc_id").agg(F.max_by("size", F.struct("n", (-F.col("first")).alias("f"))).alias("modal_size"))


def is_math(t: Column) -> Column:
    """Operators, Greek or arrows; more than a quarter unusual signs; or three words and more of which few look English."""
    odd = F.length(F.regexp_replace(t, r"""[\p{L}\p{N} .,;:!?\-–—()\[\]{}"']""", "")) / F.length(t)
    english = lambda w: F.size(F.filter(w, lambda x: F.regexp_replace(x, "^[^a-zA-Z]+|[^a-zA-Z]+$", "").rlike(r"^[A-Za-z][A-Za-z'\-]+$"))) / F.size(w)
    return (F.length(t) > 0) & (t.rlike(pattern(MATH)) | (odd > 0.25) | let(words(t), lambda w: (F.size(w) >= 3) & (english(w) < 0.35)))


def clean_text(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def headings(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """Heading lines with their level: doc_id, page_number, line_no, heading_number, heading_text, level (1 to 5 by size)."""
    x = lines.withColumn("t", clean_text(F.col("text"))).join(sizes, "doc_id")
    top = F.min(F.when((F.col("page_number") == 1) & F.col("t").rlike(pattern(ABSTRACT_HEADER, "i")), F.col("y0"))).over(Window.partitionBy("doc_id"))
    x = x.withColumn("abstract_y0", top)
    t, w = F.col("t"), words(F.col("t"))
    x = x.where((F.col("y0") >= TOP) & (F.col("y1") <= F.col("page_h") - BOTTOM) & F.length("t").between(2, 160) & ~((F.col("page_number") == 1) & F.coalesce(F.col("y0") < F.col("abstract_y0"), F.lit(False))))
    one = t.rlike(f"(?i){ROMAN}") | t.rlike(r"^[1-9]\d*\.?$") | F.regexp_replace(F.lower("t"), r"^[.:-]+|[.:-]+$", "").isin(*KNOWN_HEADINGS)
    kept = F.filter(F.transform(w, lambda v: F.regexp_replace(v, r"^[.,:;()\[\]{}]+|[.,:;()\[\]{}]+$", "")), lambda v: (v != "") & ~F.lower(v).isin(*SMALL))
    capital = let(kept, lambda k: (F.size(k) == 0) | (F.size(F.filter(k, lambda v: v.rlike(r"^[\p{Lu}\d]"))) / F.greatest(F.size(k), F.lit(1)) >= 0.6))
    x = x.where(~t.rlike(pattern(NOISE, "i")) & ~t.rlike(pattern(CODE, "i")) & ~t.rlike(pattern(TRANSITION, "i")) & t.rlike("""^[A-Z0-9“"'‘]""") & ((F.size(w) > 1) | one) & capital & ~is_math(t))
    sentence = t.rlike(r"[a-z]\. [A-Za-z]")
    enclosed = t.startswith("(") & t.endswith(")")
    caps = t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}") & F.length("t").between(3, 50) & ~t.rlike(r"[)\].]$")
    bold = F.col("bold") & (F.col("size") >= F.col("body_size") - TOLERANCE) & (F.length("t") <= 80) & ~sentence & ~t.rlike(r"[,.\]]$") & ~enclosed & ~F.contains("t", F.lit("@"))
    numbered = t.rlike(pattern(r"^[1-9]\d*(?:\.\d+)+\.?\s+[A-Z]")) & (F.length("t") <= 100) & ~sentence
    x = x.where((F.col("size") >= F.col("body_size") * LARGER - TOLERANCE) | bold | numbered | (caps & (F.col("size") >= F.col("body_size") * 0.9 - TOLERANCE) & ~sentence))
    first = F.row_number().over(Window.partitionBy("doc_id", F.lower(F.substring("t", 1, 70))).orderBy("line_no"))
    x = x.withColumn("_first", first).where("_first = 1")
    level = F.least(F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.col("size").desc())), F.lit(5))
    number = F.regexp_replace(F.regexp_extract("t", r"^(\d+(?:\.\d+)*\.?\s+)(.*)", 1), r"[.\s]+$", "")
    rest = F.trim(F.regexp_extract("t", r"^(\d+(?:\.\d+)*\.?\s+)(.*)", 2))
    return x.select("doc_id", "page_number", "line_no", F.nullif(number, F.lit("")).alias("heading_number"), F.when(rest == "", t).otherwise(rest).alias("heading_text"), level.alias("level"))


def strip_superscripts(spans_: DataFrame) -> DataFrame:
    """Spans (doc_id, line_no, pos, text, size) -> each line's text without small raised spans, unless they are punctuation alone."""
    most = F.max("size").over(Window.partitionBy("doc_id", "line_no"))
    raised = (F.col("most") - F.col("size") > 1.5) & (F.col("size") < 11) & F.col("text").rlike(r"[\p{L}\p{N}]")
    kept = spans_.withColumn("most", most).withColumn("piece", F.when(raised, "").otherwise(F.col("text")))
    return kept.groupBy("doc_id", "line_no").agg(F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")).alias("text"))


def until(lines: DataFrame, starts: DataFrame, stop: Column, most: int) -> DataFrame:
    """Lines after each document's start (doc_id, at, head): those before the first line that stops, most of them, with head joined before them."""
    near = lines.join(starts, "doc_id").where((F.col("line_no") > F.col("at")) & (F.col("line_no") <= F.col("at") + most))
    end = F.min(F.when(stop, F.col("line_no"))).over(Window.partitionBy("doc_id"))
    near = near.withColumn("end", end).where("end is null or line_no < end")
    body = near.groupBy("doc_id").agg(F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("line_no", clean_text(F.col("text")).alias("t")))), lambda x: x["t"]), lambda t: t != ""), " ").alias("rest"))
    return starts.join(body, "doc_id", "left").select("doc_id", F.trim(F.concat_ws(" ", F.nullif("head", F.lit("")), F.nullif(F.coalesce("rest", F.lit("")), F.lit("")))).alias("text"))


def abstract(lines: DataFrame) -> DataFrame:
    """The abstract of the first three pages if it has 30 words or more: doc_id, abstract_text, abstract_word_count."""
    t = F.col("text")
    own = lines.where("page_number <= 3")
    head = F.regexp_extract(t, pattern(ABSTRACT_INLINE, "i"), 1)
    marked = own.where(t.rlike(pattern(ABSTRACT_INLINE, "i")) | t.rlike(pattern(ABSTRACT_HEADER, "i")))
    starts = marked.groupBy("doc_id").agg(F.min(F.struct("line_no", clean_text(head).alias("head"))).alias("s")).select("doc_id", F.col("s.line_no").alias("at"), F.col("s.head").alias("head"))
    found = until(own, starts, t.rlike(pattern(BREAK, "i")) | t.rlike(pattern(r"^\s*(?:keywords?|index\s+terms?|key\s+words?)\b", "i")), 49)
    n = F.size(words(F.col("text")))
    return found.where(n >= 30).select("doc_id", F.col("text").alias("abstract_text"), n.alias("abstract_word_count"))


def keywords(lines: DataFrame) -> DataFrame:
    """Up to 15 keywords of the first three pages' keyword line and the line after it, unless that opens a section."""
    t = F.col("text")
    own = lines.where("page_number <= 3")
    starts = own.where(t.rlike(pattern(r"^\s*" + KEYWORD_LINE, "i"))).groupBy("doc_id").agg(F.min(F.struct("line_no", F.regexp_extract(t, pattern(KEYWORD_LINE, "i"), 1).alias("head"))).alias("s"))
    found = until(own, starts.select("doc_id", F.col("s.line_no").alias("at"), F.col("s.head").alias("head")), t.rlike(pattern(BREAK, "i")) | t.rlike(r"^\s*$") | t.rlike(r"^\s*\d"), 1)
    parts = F.filter(F.transform(F.split("text", r"[;,·|]|\s{2,}"), lambda p: F.regexp_replace(p, r"^[\s.]+|[\s.]+$", "")), lambda p: F.length(p) > 1)
    return found.select("doc_id", F.slice(parts, 1, 15).alias("keywords")).where("size(keywords) > 0")


def title(lines: DataFrame) -> DataFrame:
    """The largest lines of page 1 above the abstract, those within a point of each other in size and 80 points in place, joined."""
    t = clean_text(F.col("text"))
    p = lines.where("page_number = 1").withColumn("t", t).withColumn("end", F.coalesce(F.min(F.when(t.rlike(pattern(ABSTRACT_HEADER, "i")) | t.rlike(pattern(ABSTRACT_INLINE, "i")), F.col("y0"))).over(Window.partitionBy("doc_id")), F.col("page_h") / 2))
    p = p.where((F.col("y0") >= 45) & (F.col("y0") < F.col("end")) & (F.length("t") >= 4) & (F.size(words(F.col("t"))) >= 2) & ~F.col("t").rlike(pattern(AFFILIATION, "i")) & ~F.col("t").rlike(pattern(NOISE, "i")) & ~is_math(F.col("t")))
    top = p.withColumn("best", F.first(F.struct("size", "y0")).over(Window.partitionBy("doc_id").orderBy(F.col("size").desc(), "y0")))
    near = top.where((F.abs(F.col("size") - F.col("best.size")) <= 1) & (F.abs(F.col("y0") - F.col("best.y0")) <= 80))
    return near.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "line_no", "t"))), lambda x: x["t"]), " ").alias("title"), F.max("y1").alias("bottom"))


def authors(lines: DataFrame) -> DataFrame:
    """Names between title and abstract, at most 30: of the first six lines, split at and, &, ; and commas; 2 to 6 words, capitalised, mostly letters, no affiliation."""
    t = clean_text(F.col("text"))
    p = lines.where("page_number = 1").withColumn("t", t).join(title(lines).select("doc_id", "bottom"), "doc_id").withColumn("end", F.coalesce(F.min(F.when(t.rlike(pattern(ABSTRACT_HEADER, "i")) | t.rlike(pattern(ABSTRACT_INLINE, "i")), F.col("y0"))).over(Window.partitionBy("doc_id")), F.least(F.col("page_h") * 0.35, F.lit(300.0))))
    p = p.where((F.col("y0") >= F.col("bottom")) & (F.col("y0") < F.col("end")) & (F.col("t") != ""))
    p = p.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("y0", "line_no"))).where("r <= 6")
    joined = p.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]), ", ").alias("t"))
    names = F.transform(F.split("t", r"\s+and\s+|[&;,·]"), lambda n: F.trim(F.regexp_replace(n, r"[\d*†‡§¶]+|\b(?:PhD|Ph\.D\.|Dr\.|Prof\.|M\.Sc\.|B\.Sc\.)", "")))
    good = F.filter(names, lambda n: F.size(F.split(n, r"\s+")).between(2, 6) & n.rlike(r"^\p{Lu}") & (F.length(F.regexp_replace(n, r"[^\p{L}]", "")) >= 0.75 * F.length(F.regexp_replace(n, r"\s", ""))) & ~n.rlike(pattern(AFFILIATION, "i")))
    return joined.select("doc_id", F.slice(F.array_distinct(good), 1, 30).alias("authors")).where("size(authors) > 0")


def captions(lines: DataFrame, kind: str) -> DataFrame:
    """First caption of each figure or table number: doc_id, number, caption_text, caption_page, ends_period, caption_y0.

    A line that opens with the label; what follows mustn't be a verb that cross-references open with. Up to 9 (tables: 14)
    lines within 16 points (tables: 4) of each other and half a point in size go on with it.
    """
    p, most, gap = (r"^\s*Fig(?:ure)?\.?\s+(\d+)\b[.:]?\s*(.*)$", 9, 16) if kind == "figure" else (r"^\s*Table\s+(\d+)\b[.:]?\s*(.*)$", 14, 4)
    w = Window.partitionBy("doc_id", "page_number").orderBy("line_no")
    x = lines.withColumn("number", F.regexp_extract("text", pattern(p, "i"), 1).try_cast("int")).withColumn("rest", clean_text(F.regexp_extract("text", pattern(p, "i"), 2)))
    opens = F.col("number").isNotNull() & ~F.col("rest").rlike(pattern(CAPTION_VERBS, "i"))
    apart = (F.col("y0") - F.lag("y1").over(w) >= gap) | (F.abs(F.col("size") - F.lag("size").over(w)) >= 0.5)
    x = x.withColumn("opens", opens).withColumn("breaks", opens | F.coalesce(apart, F.lit(True)) | F.col("text").rlike(r"^\s*$") | F.col("text").rlike(r"(?i)^\s*(?:Table|Fig(?:ure)?|Algorithm)\s+\d+") | F.col("text").rlike(r"^\s*[1-9]\d*(?:\.\d+)+\.?\s+[A-Z]"))
    x = x.withColumn("run", F.sum(F.col("breaks").cast("int")).over(w)).withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "page_number", "run").orderBy("line_no"))).where(F.col("at") <= most + 1)
    piece = F.when(F.col("at") == 1, F.col("rest")).otherwise(clean_text(F.col("text")))
    g = x.groupBy("doc_id", "page_number", "run").agg(F.max(F.when((F.col("at") == 1) & F.col("opens"), F.col("number"))).alias("number"), F.min("line_no").alias("line_no"), F.min("y0").alias("caption_y0"), F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", piece.alias("t")))), lambda v: v["t"]), " ")).alias("caption_text"))
    g = g.where("number is not null").where(F.length("caption_text") >= 3) if kind == "figure" else g.where("number is not null").withColumn("caption_text", F.when(F.col("caption_text") == "", F.concat(F.lit("(unlabeled table "), "number", F.lit(")"))).otherwise(F.col("caption_text")))
    g = g.withColumn("_first", F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("line_no"))).where("_first = 1")
    return g.select("doc_id", "number", "caption_text", F.col("page_number").alias("caption_page"), F.col("caption_text").endswith(".").alias("ends_period"), "caption_y0")


def first_mentions(lines: DataFrame, kind: str) -> DataFrame:
    """(doc_id, number, first_mention_page) of each number that the text mentions."""
    p = r"\bFig(?:ure)?s?\.?\s*(\d+)\b" if kind == "figure" else r"\bTables?\s*(\d+)\b"
    found = lines.select("doc_id", "page_number", F.explode(F.regexp_extract_all("text", F.lit(pattern(p, "i")), F.lit(1))).alias("n"))
    return found.select("doc_id", "page_number", F.col("n").try_cast("int").alias("number")).where("number is not null").groupBy("doc_id", "number").agg(F.min("page_number").alias("first_mention_page"))


def discover(lines: DataFrame, kind: str) -> DataFrame:
    """Figures: captions and mentions, full outer, mentions without a caption only up to two beyond the largest caption (10 without any). Tables: captions only."""
    c, m = captions(lines, kind), first_mentions(lines, kind)
    if kind == "table":
        j = c.join(m, ["doc_id", "number"], "left")
    else:
        limit = c.groupBy("doc_id").agg((F.max("number") + 2).alias("limit"))
        j = c.join(m, ["doc_id", "number"], "full_outer").join(limit, "doc_id", "left").where(F.col("caption_text").isNotNull() | (F.col("number") <= F.coalesce("limit", F.lit(10))))
    page = F.coalesce("caption_page", "first_mention_page")
    return j.select("doc_id", "number", "caption_text", page.alias("caption_page"), F.coalesce("first_mention_page", page).alias("first_mention_page"))


def match_images(captions_: DataFrame, images: DataFrame) -> DataFrame:
    """Images (doc_id, page_number, img, x0, y0, x1, y1) to captions (doc_id, number, caption_page, caption_y0), in the figures' order, each image once.

    On the caption's page images above it within 500 points: nearest in steps of 5, then largest; else the previous page's largest. A document's figures and images are bounded by its pages, so each document is one row: a fold over its captions that holds the images still free. Images without an id are left out.
    """
    area = ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double")
    i = images.withColumn("area", area).where((F.col("area") >= 400) & ~F.isnan("area") & F.col("img").isNotNull())
    i = i.select("doc_id", F.lit(None).alias("c"), F.struct("page_number", F.col("img").cast("long").alias("img"), F.col("y1").cast("double").alias("y1"), "area").alias("i"))
    c = captions_.select("doc_id", F.struct(F.col("number").isNull(), F.col("number").cast("int").alias("number"), F.col("caption_page").alias("page"), F.col("caption_y0").cast("double").alias("y0")).alias("c"), F.lit(None).alias("i"))
    each = c.unionByName(i).groupBy("doc_id").agg(F.sort_array(F.collect_list("c")).alias("c"), F.collect_list("i").alias("i")).where((F.size("c") > 0) & (F.size("i") > 0))

    def here(x: Column, r: Column) -> Column:
        return F.coalesce((x["page_number"] == r["page"]) & (x["y1"] <= r["y0"]) & (r["y0"] - x["y1"] <= 500), F.lit(False))

    def match(held: Column, r: Column) -> Column:
        can = F.filter(held["free"], lambda x: here(x, r) | (x["page_number"] == r["page"] - 1))
        step = lambda x: F.when(here(x, r), F.rint((r["y0"] - x["y1"]) / 5)).otherwise(F.lit(0.0))
        best = F.array_min(F.transform(can, lambda x: F.struct(~here(x, r), step(x), -x["area"], x["img"].alias("img"))))["img"]
        # As the one element of an array, so that it is found once.
        taken = F.transform(F.array(best), lambda img: F.when(img.isNull(), held).otherwise(F.struct(F.filter(held["free"], lambda x: x["img"] != img).alias("free"), F.concat(held["found"], F.array(F.struct(r["number"].alias("number"), img.alias("img")))).alias("found"))))
        return taken[0]

    none = F.struct(F.col("i").alias("free"), F.array().cast("array<struct<number:int,img:bigint>>").alias("found"))
    found = each.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.aggregate("c", none, match, lambda held: held["found"])).alias("m"))
    return found.select("doc_id", "m.number", "m.img")


# Reference lists in the layout.
def reference_layout_lines(lines: DataFrame) -> DataFrame:
    """Lines within the margins that are neither blank nor captions."""
    return lines.where((F.col("y0") >= 55) & (F.col("y1") <= F.col("page_h") - 55) & ~F.col("text").rlike(r"^\s*$") & ~F.col("text").rlike(r"(?i)^\s*(?:Table|Figure|Figs?)\b"))


def reference_start_page(lines: DataFrame) -> DataFrame:
    """(doc_id, start_page, start_line): the last page with a reference header within the margins."""
    heads = lines.where((F.col("y0") >= 55) & (F.col("y1") <= F.col("page_h") - 55) & F.col("text").rlike(pattern(r"^\s*(?:\d+\.?\s+)?(?:references?|bibliography|literature cited)\s*$", "i")))
    return heads.groupBy("doc_id").agg(F.max(F.struct("page_number", (-F.col("line_no")).alias("l"))).alias("s")).select("doc_id", F.col("s.page_number").alias("start_page"), (-F.col("s.l")).alias("start_line"))


def two_columns(lines: DataFrame) -> DataFrame:
    """Pages with more than three lines, and more than a tenth, right of 45 % of the width."""
    right = F.count(F.when(F.col("x0") > 0.45 * F.col("page_w"), 1))
    return lines.groupBy("doc_id", "page_number").agg(right.alias("right_lines"), F.count("*").alias("n")).select("doc_id", "page_number", ((F.col("right_lines") > 3) & (F.col("right_lines") > 0.1 * F.col("n"))).alias("two_column"))


def in_reading_order(lines: DataFrame) -> DataFrame:
    """Lines with col (0 or 1) and seq in reading order: page, column, height."""
    x = lines.join(two_columns(lines), ["doc_id", "page_number"]).withColumn("col", (F.col("two_column") & (F.col("x0") > 0.45 * F.col("page_w"))).cast("int"))
    return x.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "col", "y0", "line_no")))


def after_header(lines: DataFrame) -> DataFrame:
    """Lines of the reference list in reading order: what follows the header on its page, and the pages after."""
    x = in_reading_order(lines).join(reference_start_page(lines), "doc_id")
    at = F.max(F.when(F.col("line_no") == F.col("start_line"), F.col("seq"))).over(Window.partitionBy("doc_id"))
    return x.withColumn("at", at).where("seq > at").drop("at", "two_column", "start_page", "start_line")


def layout_style(lines: DataFrame) -> DataFrame:
    """(doc_id, style) by how many lines open with [n] or n. (three at least), else APA."""
    b, d = (F.count(F.when(F.col("text").rlike(p), 1)) for p in (r"^\s*\[\d+\]", r"^\s*(?!(?:19|20)\d{2}\.)\d+\.\s"))
    g = lines.groupBy("doc_id").agg(b.alias("b"), d.alias("d"))
    return g.select("doc_id", F.when((F.col("b") >= 3) & (F.col("b") >= F.col("d")), "numbered-bracket").when(F.col("d") >= 3, "dot-number").otherwise("apa-style").alias("style"))


def items(lines: DataFrame) -> DataFrame:
    """Reference lines (doc_id, seq, page_number, text, x0, y0, x1, y1) -> with item: a line opens one by its label, or in APA by standing 5 points left of the line before or 4.5 points below it."""
    x = lines.join(layout_style(lines), "doc_id")
    w = Window.partitionBy("doc_id").orderBy("seq")
    label = F.when(F.col("style") == "numbered-bracket", F.col("text").rlike(r"^\s*\[\d+\]")).when(F.col("style") == "dot-number", F.col("text").rlike(r"^\s*\d+\.\s"))
    hang = (F.lag("x0").over(w) - F.col("x0") >= 5) | (F.col("y0") - F.lag("y1").over(w) > 4.5)
    return x.withColumn("item", F.sum(F.coalesce(label, hang, F.lit(True)).cast("int")).over(w)).where("item > 0")


def assembled(rows: DataFrame) -> DataFrame:
    """Items -> doc_id, item, number, raw_string, page, x0, y0, x1, y1 (of the lines on its first page)."""
    first = F.min("page_number").over(Window.partitionBy("doc_id", "item"))
    own = F.col("page_number") == F.col("first")
    raw = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    g = rows.withColumn("first", first).groupBy("doc_id", "item").agg(F.max("style").alias("style"), raw.alias("raw"), F.min("first").alias("page"), *(f(F.when(own, F.col(c))).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))
    r = F.trim(F.regexp_replace("raw", r"(?U)\s+", " "))
    for a, b in ((r"-\s+", "-"), (r"/\s+", "/"), (r"\.\s+(com|org|net|edu|gov|mil|int)\b", ".$1")):
        r = F.regexp_replace(r, a, b)
    number = F.when(F.col("style") != "apa-style", F.regexp_extract("raw", r"(\d+)", 1).try_cast("int"))
    return g.select("doc_id", "item", number.alias("number"), r.alias("raw_string"), "page", "x0", "y0", "x1", "y1")


def fold_accents(c: Column) -> Column:
    """Lower case without combining marks, for any script; Spark has no normalisation of its own."""

    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower())

    return F.pandas_udf(fold, StringType())(c)
