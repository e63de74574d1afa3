"""References and in-text citations of manuscripts, and how they match.

Lines of a reference section are exploded once and shuffled by document only for what spans lines: which line opens an
entry, its continuation, first-wins deduplication.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.text import around, pattern, spans

STYLES = ("numbered-bracket", "dot-number", "apa-style")
# Fixed values.
OPENERS = (r"^\s*\[(\d+)\]\s+(.+)", r"^\s*(\d+)\.\s+([A-Z].+)", r"^\s*([A-Z][^(\n]{2,120}\((?:19|20)\d{2}\)\s*\..+)")
#: A line that another entry opens: the last alternative needs no text behind the period.
BREAKS = (OPENERS[0], OPENERS[1], r"^\s*[A-Z][^(\n]{2,120}\((?:19|20)\d{2}\)\s*\.", r"(?i)^\s*(?:Table|Figure|Fig\.)\s+\d+")
CONTINUED_CHARS, CONTINUED_LINES = 600, 6


def year_of(raw: Column) -> Column:
    return F.expr("null").cast("int") if raw is None else F.nullif(F.regexp_extract(raw, pattern(r"\b((?:19|20)\d{2})\b"), 1), F.lit("")).cast("int")


def doi_of(raw: Column, layout: bool = False) -> Column:
    """Text mode keeps the prefix and any closing punctuation; layout mode also takes bare DOIs and strips what closes them."""
    prefixed = F.nullif(F.regexp_replace(F.regexp_extract(raw, pattern(r"(?:doi\s*:\s*|https?://(?:dx\.)?doi\.org/)\s*(\S+)", "i"), 0), r"(?U)\s+", ""), F.lit(""))
    if not layout:
        return prefixed
    bare = F.nullif(F.regexp_extract(raw, pattern(r"\b(10\.\d{4,9}/\S+)", "i"), 1), F.lit(""))
    return F.regexp_replace(F.coalesce(prefixed, bare), r"[.,;()\[\]{}]+$", "")


def url_of(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, r"(https?://\S+)", 1), F.lit(""))


def section_start(text: Column) -> Column:
    """0-based start of the reference list: the last header line beyond half of the text, else the last header line, else the last such word not within another; 0 if none."""
    heads = F.transform(spans(text, pattern(r"^\s*(?:references|bibliography|literature cited|reference)\s*$", "im")), lambda s: s["start"])
    words = F.transform(spans(F.lower(text), pattern(r"(?<![\p{L}\p{N}])(?:references|bibliography|literature cited)")), lambda s: s["start"])
    late = F.array_max(F.filter(heads, lambda h: h > F.length(text) * 0.5))
    return F.coalesce(late, F.array_max(heads), F.array_max(words), F.lit(0))


def reference_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, full_text) -> lines of the reference list: doc_id, line_no, line, style (0..2 it opens, or null), stops (it can't continue an entry)."""
    part = F.substring(F.col("full_text"), section_start(F.col("full_text")) + 1, F.length("full_text"))
    lines = docs.select("doc_id", F.posexplode(F.split(part, "\n")).alias("line_no", "line"))
    style = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(OPENERS))):
        style = F.when(F.col("line").rlike(pattern(p)), i).otherwise(style)
    stops = F.col("line").rlike(r"(?U)^\s*$") | F.contains("line", F.lit("ACCEPTED MANUSCRIPT"))
    for p in BREAKS:
        stops = stops | F.col("line").rlike(pattern(p))
    return lines.select("doc_id", "line_no", "line", style.alias("style"), stops.alias("stops"))


def entries(docs: DataFrame) -> DataFrame:
    """References of the style with the most entries: doc_id, style, pos, number, raw_string, year, doi, url.

    An entry is its opening line and up to CONTINUED_LINES lines, within CONTINUED_CHARS, up to one that stops it. Entries that
    agree in their first 80 characters, ignoring case, are one. Of equally many entries the style listed first wins.
    """
    lines = reference_lines(docs)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    # An entry's number: so many openers up to here; a stop that opens nothing closes it.
    lines = lines.withColumn("entry", F.sum(F.when(F.col("style").isNotNull() | F.col("stops"), 1).otherwise(0)).over(w))
    lines = lines.withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "entry").orderBy("line_no")))
    chars = F.sum(F.when(F.col("at") > 1, F.length("line") + 1)).over(Window.partitionBy("doc_id", "entry").orderBy("line_no")) - 1
    opens = F.col("at") == 1
    kept = lines.withColumn("cut", F.when(opens, F.col("line")).otherwise(F.substring(F.col("line"), F.lit(1), F.greatest(CONTINUED_CHARS - (chars - F.length("line")), F.lit(0))))).where(F.col("at") <= CONTINUED_LINES + 1)
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    raw = F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("line_no", strip(F.col("cut")).alias("t")))), lambda x: x["t"]), lambda t: t != ""), " ")
    e = kept.groupBy("doc_id", "entry").agg(F.max(F.when(opens, F.col("style"))).alias("k"), F.min("line_no").alias("pos"), raw.alias("raw_string")).where("k is not null")
    first = Window.partitionBy("doc_id", "k", F.lower(F.substring("raw_string", 1, 80))).orderBy("pos")
    e = e.withColumn("_first", F.row_number().over(first)).where("_first = 1")
    e = e.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "k"))).withColumn("best", F.max(F.struct("n", (-F.col("k")).alias("k"))).over(Window.partitionBy("doc_id"))["k"] * -1).where("k = best")
    number = F.when(F.col("k") < 2, F.regexp_extract("raw_string", r"^\[?(\d+)", 1).cast("int"))
    names = F.array(*map(F.lit, STYLES))
    raw = F.col("raw_string")
    return e.select("doc_id", F.element_at(names, F.col("k") + 1).alias("style"), "pos", number.alias("number"), "raw_string", year_of(raw).alias("year"), doi_of(raw).alias("doi"), url_of(raw).alias("url"))


def max_number(text: Column) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int")))


def citations(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, full_text, offsets), refs(doc_id, number) -> first occurrence of each marker: doc_id, seq, marker, style, pos, context_snippet.

    Numeric markers are passed over if the document's references have no numbers, or if they go more than 5 beyond the
    largest. Numeric markers come first, then author-year ones, whose year may be missing.
    """
    stats = refs.groupBy("doc_id").agg(F.count("*").alias("n_refs"), F.max("number").alias("max_ref"))
    text = F.col("full_text")
    found = F.array(F.struct(F.lit(0).alias("k"), spans(text, pattern(r"\[[1-9][\d,\s\-–]*\]")).alias("s")), F.struct(F.lit(1).alias("k"), spans(text, pattern(r"\([A-Z][a-zA-Z]+(?:\s+(?:and|&|et al\.?))?\s*(?:[A-Z][a-zA-Z]+)?(?:,\s*(?:19|20)\d{2})?\)")).alias("s")))
    rows = docs.select("doc_id", "full_text", F.explode(found).alias("f")).select("doc_id", "full_text", F.col("f.k").alias("k"), F.explode("f.s").alias("s"))
    context = F.trim(F.replace(around(text, F.col("s.start"), F.col("s.end"), 60), F.lit("\n"), F.lit(" ")))
    rows = rows.select("doc_id", "k", F.col("s.start").alias("pos"), F.col("s.found").alias("marker"), context.alias("context_snippet"))
    rows = rows.join(stats, "doc_id", "left")
    rows = rows.where((F.col("k") == 1) | F.col("n_refs").isNull() | (F.col("max_ref").isNotNull() & ((F.col("max_ref") <= 0) | (max_number(F.col("marker")) <= F.col("max_ref") + 5))))
    rows = rows.withColumn("_first", F.row_number().over(Window.partitionBy("doc_id", "marker").orderBy("k", "pos"))).where("_first = 1")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("k", "pos"))
    return rows.select("doc_id", seq.alias("seq"), "marker", F.when(F.col("k") == 0, "numeric-bracket").otherwise("author-year").alias("style"), "pos", "context_snippet")


def citation_numbers(marker: Column) -> Column:
    """Numbers of a marker: parts between commas or semicolons, ranges spelled out below 50 long; none at all if any repeats."""
    inner = F.regexp_replace(marker, r"[\[\](){}]", " ")
    parts = F.transform(F.split(inner, r"[,;]\s*"), lambda p: F.trim(p))
    lo, hi = (lambda p, i=i: F.regexp_extract(p, r"^(\d+)\s*[-–—]\s*(\d+)", i).try_cast("int") for i in (1, 2))

    def expand(p: Column) -> Column:
        span = F.when((hi(p) - lo(p) > 0) & (hi(p) - lo(p) < 50), F.sequence(lo(p), hi(p))).otherwise(F.array().cast("array<int>"))
        one = F.regexp_extract(p, r"^(\d+)$", 1).try_cast("int")
        return F.when(lo(p).isNotNull(), span).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<int>"))

    every = F.flatten(F.transform(parts, expand))
    return F.when(F.size(every) == F.size(F.array_distinct(every)), every).otherwise(F.array().cast("array<int>"))


def bidirectional(refs: DataFrame, cited: DataFrame) -> DataFrame:
    """refs(doc_id, number), cited(doc_id, number, page, pos): numbers cited but not listed, and listed but not cited.

    Numbers beyond the largest listed by a fifth of it, at least 5, are no citations. Documents with citations of which none
    is left are passed over. One full outer join on (doc_id, number).
    """
    r = refs.where("number > 0").select("doc_id", "number").distinct()
    most = r.groupBy("doc_id").agg(F.max("number").alias("most"))
    c = cited.where("number > 0").groupBy("doc_id", "number").agg(F.min_by("page", F.struct("pos", "page")).alias("page")).join(most, "doc_id", "left")
    c = c.where(F.col("most").isNull() | (F.col("number") <= F.col("most") + F.greatest(F.lit(5), F.floor(F.col("most") * 0.2))))
    tried, left = cited.select("doc_id").distinct(), c.select("doc_id").distinct()
    skipped = tried.join(left, "doc_id", "left_anti")
    both = c.select("doc_id", "number", "page", F.lit(1).alias("c")).join(r.join(skipped, "doc_id", "left_anti").withColumn("r", F.lit(1)), ["doc_id", "number"], "full_outer").where("c is null or r is null")
    kind = F.when(F.col("r").isNull(), "missing_from_refs").otherwise("uncited_ref")
    out = both.select("doc_id", kind.alias("type"), "number", F.when(F.col("r").isNull(), F.col("page")).alias("page"))
    return out.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("type", "number")))
