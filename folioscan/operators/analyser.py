"""Checks over bibliography entries: required and consistent fields, style, order, DOI, journal casing, completeness.

Entries are rows (doc_id, pos, author, title, journal, publisher, year, volume, pages, doi, url, raw, kind). Checks within
an entry are projections; those within a document shuffle once by it.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.text import let, pattern
from folioscan.operators.references import doi_of

KINDS = ("article", "inproceedings", "inbook", "misc", "article")
STYLES = ("IEEE", "APA", "MLA", "HARVARD", "VANCOUVER")
# Required and recommended fields by style and type.
SCHEMA = {
    "IEEE": {"article": (("authors", "title", "container_title", "pub_date", "volume", "pages"), ("issue", "doi")), "book": (("authors", "title", "publisher", "pub_date"), ("doi",)), "chapter": (("authors", "title", "container_title", "publisher", "pub_date", "pages"), ()), "web": (("authors", "title", "pub_date"), ("url",)), "other": (("authors", "title", "pub_date"), ())},
    "APA": {"article": (("authors", "title", "container_title", "pub_date", "volume"), ("issue", "pages", "doi")), "book": (("authors", "title", "publisher", "pub_date"), ("doi",)), "chapter": (("authors", "title", "container_title", "pub_date", "pages"), ("publisher",)), "web": (("authors", "title", "pub_date"), ("url",)), "other": (("authors", "title", "pub_date"), ())},
    "MLA": {"article": (("authors", "title", "container_title", "pub_date", "volume", "pages"), ("issue", "doi")), "book": (("authors", "title", "publisher", "pub_date"), ()), "chapter": (("authors", "title", "container_title", "publisher", "pub_date", "pages"), ()), "web": (("authors", "title", "pub_date"), ("url",)), "other": (("authors", "title", "pub_date"), ())},
    "HARVARD": {"article": (("authors", "title", "container_title", "pub_date", "volume"), ("issue", "pages")), "book": (("authors", "title", "publisher", "pub_date"), ()), "chapter": (("authors", "title", "container_title", "pub_date", "pages"), ("publisher",)), "web": (("authors", "title", "pub_date"), ("url",)), "other": (("authors", "title", "pub_date"), ())},
    "VANCOUVER": {"article": (("authors", "title", "container_title", "pub_date", "volume", "pages"), ("issue", "doi")), "book": (("authors", "title", "publisher", "pub_date"), ()), "chapter": (("authors", "title", "container_title", "publisher", "pub_date", "pages"), ()), "web": (("authors", "title"), ("pub_date", "url")), "other": (("authors", "title"), ("pub_date",))},
}
SMALL_WORDS = "a an the and but for nor or so yet at by in of off on out to up as if into onto upon with from over between through".split()
PREFIXES = ("van der", "van den", "van de", "von der", "degli", "della", "del", "van", "von", "mac", "las", "les", "de", "di", "du", "da", "le", "la", "el", "al", "mc", "o'")
REQUIRED = {"article": ("author", "journal", "title", "year"), "inproceedings": ("author", "booktitle", "title", "year"), "inbook": ("author", "publisher", "title", "year")}
COMMON_FIELDS = ("title", "author", "year", "month", "note", "abstract")


def schema_rows() -> list[tuple]:
    """(style, type, field, level, position)."""
    return [(s, t, f, level, i) for s, types in SCHEMA.items() for t, both in types.items() for level, fields in zip(("required", "recommended"), both) for i, f in enumerate(fields)]


def filled(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) != ""


def ref_type() -> Column:
    return F.when(filled("journal") & filled("publisher"), "chapter").when(filled("journal"), "article").when(filled("publisher"), "book").when(filled("url"), "web").otherwise("other")


def style_of_kind() -> Column:
    return F.element_at(F.array(*map(F.lit, STYLES)), F.col("kind").cast("int") + 1)


def dominant_style(styled: DataFrame) -> DataFrame:
    """(doc_id, pos, style, confidence) -> the most common style of the highest confidence at which it has a quarter of the entries and isn't Unknown; the first seen wins ties."""
    v = styled.groupBy("doc_id", "confidence", "style").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    doc = Window.partitionBy("doc_id", "confidence")
    v = v.withColumn("total", F.sum("n").over(doc)).withColumn("r", F.row_number().over(doc.orderBy(F.col("n").desc(), "first"))).where("r = 1 and n >= 0.25 * total and style <> 'Unknown'")
    rank = F.array_position(F.array(*map(F.lit, ("HIGH", "MEDIUM", "LOW"))), F.col("confidence"))
    return v.groupBy("doc_id").agg(F.min_by("style", rank).alias("dominant"))


def style_conformity(styled: DataFrame) -> DataFrame:
    """Entries of more than low confidence whose style isn't the document's."""
    return styled.where("confidence <> 'LOW'").join(dominant_style(styled), "doc_id").where("style <> dominant").select("doc_id", "pos", "style", "dominant")


def numeric_order(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, raw) -> entries whose label isn't one more than the last label before them, or that have none: label, expected."""
    label = F.nullif(F.regexp_extract("raw", r"^\[?(\d+)\]?\.?\s", 1), F.lit("")).try_cast("int")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    r = rows.select("doc_id", "pos", label.alias("label")).withColumn("expected", F.coalesce(F.last("label", ignorenulls=True).over(w) + 1, F.lit(1)))
    return r.where("label is null or label <> expected")


#: Characters that are one other character with marks, or a form of one, and that character.
FOLDED = {chr(c): x for c in range(0x80, 0x10000) if not 0xAC00 <= c < 0xE000 and len(x := "".join(y for y in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(y))) == 1 and x != chr(c)}


def fold_accents(c: Column) -> Column:
    """Lower case without marks. Characters that decompose into several others, ligatures mostly, stay as they are."""
    bare = F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), "".join(FOLDED), "".join(FOLDED.values()))
    return F.lower(bare)


def alpha_order(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, author, year) -> entries that sort before the entry before them: sort_key, previous. Keys: surname without one prefix, then the year."""
    surname = fold_accents(F.regexp_extract("author", r"^([^,]+)", 1))
    key = F.concat(F.regexp_replace(surname, "^(?:" + "|".join(PREFIXES) + ") ", ""), F.lit("_"), F.when(filled("year"), F.substring("year", 1, 4)).otherwise("9999"))
    usable = rows.where(filled("author")).select("doc_id", "pos", key.alias("sort_key"))
    return usable.withColumn("previous", F.lag("sort_key").over(Window.partitionBy("doc_id").orderBy("pos"))).where("sort_key < previous")


def doi_missing(rows: DataFrame) -> DataFrame:
    """Articles and chapters without a DOI in their field or their text."""
    return rows.where(ref_type().isin("article", "chapter") & ~filled("doi") & doi_of(F.col("raw"), True).isNull()).select("doc_id", "pos")


def journal_of(c: str) -> Column:
    """A title of over 60 characters that ends in ". Some Journal" is that journal."""
    last = F.nullif(F.trim(F.regexp_extract(c, r"\.\s+([A-Z][^.]{4,})$", 1)), F.lit(""))
    return F.when(F.length(c) <= 60, F.col(c)).otherwise(F.coalesce(last, F.col(c)))


def journal_casing(rows: DataFrame) -> DataFrame:
    """Entries whose journal is written unlike the most common form of it in the document; the first seen wins ties."""
    key = F.trim(F.regexp_replace(F.regexp_replace(fold_accents(F.col("journal")), r"[^a-z0-9\s]", ""), r"\s+", " "))
    j = rows.where(filled("journal")).select("doc_id", "pos", journal_of("journal").alias("journal")).withColumn("key", key)
    w = Window.partitionBy("doc_id", "key", "journal")
    j = j.withColumn("n", F.count("*").over(w)).withColumn("first", F.min("pos").over(w))
    j = j.withColumn("dominant", F.max(F.struct("n", (-F.col("first")).alias("f"), "journal")).over(Window.partitionBy("doc_id", "key"))["journal"])
    return j.where("journal <> dominant").select("doc_id", "pos", "journal", "dominant")


def core(w: Column) -> Column:
    return F.regexp_replace(w, r"^[.,;:!?()\[\]]+|[.,;:!?()\[\]]+$", "")


def small(w: Column, i: Column, n: Column) -> Column:
    return F.lower(core(w)).isin(*SMALL_WORDS) & (i > 0) & (i < n - 1)


def title_words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def casing_label(c: Column) -> Column:
    def judge(w: Column) -> Column:
        wrong = F.filter(w, lambda x, i: F.when(small(x, i, F.size(w)), core(x).rlike(r"^\p{Lu}")).otherwise(core(x).rlike(r"^\p{Ll}")))
        lower = F.size(F.filter(F.slice(w, 2, 10000), lambda x: core(x).rlike(r"^\p{Ll}")))
        letters = c.rlike(r"\p{L}")
        return F.when(letters & ~c.rlike(r"\p{Ll}"), "ALL_CAPS").when(letters & ~c.rlike(r"\p{Lu}"), "all_lowercase").when(F.size(wrong) == 0, "Title Case").when(lower * 2 >= F.size(w) - 1, "Sentence case").otherwise("Mixed/inconsistent case")

    return let(title_words(F.regexp_replace(c, "[*_\"']", "")), judge)


def title_case(c: Column) -> Column:
    return let(title_words(c), lambda w: F.array_join(F.transform(w, lambda x, i: F.when(small(x, i, F.size(w)), F.lower(x)).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1000)))), " "))


def authors_of(c: Column) -> Column:
    """Names split at " and "; "Surname, First" turned round."""
    return F.transform(F.split(c, r"\s+and\s+"), lambda a: F.when(F.contains(a, F.lit(",")), F.concat(F.trim(F.element_at(F.split(a, ","), 2)), F.lit(" "), F.trim(F.element_at(F.split(a, ","), 1)))).otherwise(F.trim(a)))


def entry_type() -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind").cast("int") + 1)


def present() -> Column:
    return F.filter(F.array(*(F.when(filled(f), F.lit(f)) for f in ("author", "title", "journal", "year", "volume", "pages", "doi", "publisher"))), lambda x: x.isNotNull())


def needed() -> Column:
    out = F.array().cast("array<string>")
    for t, fields in REQUIRED.items():
        out = F.when(entry_type() == t, F.array(*map(F.lit, fields))).otherwise(out)
    return out


def required_fields(rows: DataFrame) -> DataFrame:
    """Entries that lack a field their type needs."""
    missing = F.array_sort(F.array_except(needed(), present()))
    return rows.select("doc_id", "pos", missing.alias("m")).where("size(m) > 0").select("doc_id", "pos", F.array_join("m", ",").alias("missing"))


def field_consistency(rows: DataFrame) -> DataFrame:
    """Entries whose further fields differ from those of the document's first entry of their type."""
    extra = F.array_except(F.array_except(present(), needed()), F.array(*map(F.lit, COMMON_FIELDS)))
    e = rows.select("doc_id", "pos", entry_type().alias("type"), extra.alias("x")).withColumn("p", F.first("x").over(Window.partitionBy("doc_id", "type").orderBy("pos")))
    differ = F.array_sort(F.concat(F.array_except("x", "p"), F.array_except("p", "x")))
    return e.select("doc_id", "pos", "type", F.array_join(differ, ",").alias("differing")).where("differing <> ''")


def reconstruct(rows: DataFrame) -> DataFrame:
    """A reference string from an entry's fields; empty parts are left out."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    parts = (F.concat(F.lit("["), n, F.lit("]")), F.concat("author", F.lit(".")), F.concat(F.lit('"'), "title", F.lit('."')), F.col("journal"), F.concat(F.lit("vol. "), "volume"), F.when(filled("year"), F.concat(F.lit("("), "year", F.lit(")"))), F.concat(F.lit("pp. "), "pages"), F.concat(F.lit("doi:"), "doi"))
    return rows.select("doc_id", "pos", F.concat_ws(" ", *parts).alias("raw_string"))


def completeness(rows: DataFrame) -> DataFrame:
    """Required fields that are missing, and recommended ones (suspicious), by the schema of an entry's style and type."""
    schema = F.broadcast(rows.sparkSession.createDataFrame(schema_rows(), "s_style string, s_type string, s_field string, level string, n int"))  # fixed size
    names = {"authors": "author", "title": "title", "container_title": "journal", "pub_date": "year", "volume": "volume", "issue": None, "pages": "pages", "doi": "doi", "url": "url", "publisher": "publisher"}
    empty = F.filter(F.array(*(F.when(F.lit(True) if c is None else ~filled(c), F.lit(f)) for f, c in names.items())), lambda x: x.isNotNull())
    e = rows.select("doc_id", "pos", style_of_kind().alias("style"), ref_type().alias("type"), F.explode(empty).alias("field"))
    j = e.join(schema, (F.col("style") == F.col("s_style")) & (F.col("type") == F.col("s_type")) & (F.col("field") == F.col("s_field")))
    return j.select("doc_id", "pos", "style", "type", "field", F.when(F.col("level") == "required", "missing").otherwise("suspicious").alias("issue_type"))


def formatting(rows: DataFrame) -> DataFrame:
    """Formatting issues of entries under their style, and values that look misplaced under any."""
    style, raw = style_of_kind(), F.col("raw")
    dated = filled("year")
    early = F.contains(raw, F.col("year")) & (F.length(raw) - F.instr(F.reverse(raw), F.reverse("year")) - F.length("year") + 1 < F.length(raw) * 0.4)
    issues = (
        ("year_parentheses", style.isin("APA", "HARVARD") & dated & ~raw.rlike(r"\(\d{4}\)")),
        ("pages_pp", (style == "MLA") & filled("pages") & ~raw.rlike(pattern(r"\bpp?\.\s")) & ref_type().isin("article", "chapter")),
        ("volume_label", (style == "MLA") & F.col("volume").rlike(r"^\d+$") & ~raw.rlike(pattern(r"\bvol\.\s*\d", "i"))),
        ("year_early", (style == "MLA") & dated & raw.rlike(r"\b(?:19|20)\d{2}\b") & early),
        ("year_volume_pages", (style == "VANCOUVER") & dated & filled("volume") & filled("pages") & ~raw.rlike(r"\d{4};\d+")),
        ("pages_year", F.col("pages").rlike(r"^(?:19|20)\d{2}$")),
        ("volume_day", F.col("volume").rlike(r"^(?:[1-9]|[12]\d|3[01])$") & raw.rlike(pattern(r"\b(?:accessed|retrieved|cited)\b", "i"))),
        ("date_not_year", dated & ~F.regexp_replace("year", "[()]", "").rlike(r"^(?:19|20)\d{2}$") & ~F.lower("year").isin("n.d.", "nd", "no date", "forthcoming")),
    )
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in issues)), lambda x: x.isNotNull())
    return rows.select("doc_id", "pos", style.alias("style"), F.explode(found).alias("issue"))


def parsed_fields() -> list[Column]:
    """An entry's fields under the names that the checks use, with their fallbacks."""
    return [F.array_join(authors_of(F.col("author")), "; ").alias("authors"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("journal", "booktitle", F.lit("")).alias("container_title"), F.coalesce(F.nullif("year", F.lit("")), "date", F.lit("")).alias("pub_date"), F.lower(F.coalesce("entry_type", F.lit("misc"))).alias("entry_type")]


def casing_by_style(rows: DataFrame) -> DataFrame:
    """Journals that break the casing rule of an entry's style: issue_type and suggestion. All capitals over 4 characters first, then several words in lower case, then what isn't title case where the style asks for it."""
    j, label = F.col("journal"), casing_label(F.col("journal"))
    words_ = F.size(title_words(j))
    kind = F.when((label == "ALL_CAPS") & (F.length(j) > 4), "all_caps").when((label == "all_lowercase") & (words_ > 1), "wrong_case")
    kind = kind.when(style_of_kind().isin("APA", "MLA", "HARVARD", "IEEE") & ~label.isin("ALL_CAPS", "Title Case"), "wrong_case").when((style_of_kind() == "VANCOUVER") & (label == "all_lowercase"), "wrong_case")
    suggestion = F.when(F.col("issue_type") == "all_caps", F.initcap(F.lower(j))).otherwise(title_case(j))
    return rows.where(filled("journal")).select("doc_id", "pos", "journal", style_of_kind().alias("style"), kind.alias("issue_type")).where("issue_type is not null").withColumn("suggestion", suggestion)


def quality_issues(rows: DataFrame, styled: DataFrame | None = None, cap: int | None = 50) -> DataFrame:
    """Issues of the checks in their order (ordering, DOI, casing, completeness, then style conformity if styled is given): doc_id, seq, check, pos; at most cap of a document."""
    parts = [("ordering", alpha_order(rows)), ("doi", doi_missing(rows)), ("journal_casing", journal_casing(rows)), ("completeness", completeness(rows))]
    if styled is not None:
        parts.append(("style_conformity", style_conformity(styled)))
    out = None
    for i, (name, df) in enumerate(parts):
        one = df.select("doc_id", F.lit(i).alias("check_no"), F.lit(name).alias("check"), "pos", (F.col("field") if "field" in df.columns else F.lit("")).alias("field"))
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("check_no", "pos", "field")))
    return (out.where(F.col("seq") <= cap) if cap else out).select("doc_id", "seq", "check", "pos", "field")
