"""Column functions over document text: spans of a pattern, blanking, snippets, page lookup.

Patterns are Java's under (?Ud), so word, digit, space and boundary classes are Unicode's and only a line feed ends a
line. Offsets are code points, as in Spark's length() and substring(). All stay in the JVM; no pattern may match an
empty string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"
BLOCK = 32
SPAN = "array<struct<start:int,end:int,found:string,g1:string,g2:string>>"


def pattern(p: str, flags: str = "") -> str:
    return f"(?Ud{flags}){p}"


def let(value: Column, then) -> Column:
    """then(value) with value evaluated once for a row, however often then uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def spans(text: Column, p: str, groups: int = 0) -> Column:
    """Leftmost non-overlapping matches of p: array of (start, end, found, g1, g2), the latter null beyond groups. A match's start is the length of all before it.

    Texts without a match are searched once. Else a fold runs over the matches and the stretches between them, in blocks:
    appending to one long array would copy it each time.
    """

    def grow(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        row = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("found"), x["g1"].alias("g1"), x["g2"].alias("g2"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        first = F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("out"))
        return let(F.aggregate(part, first, grow), lambda got: F.struct(got["at"].alias("at"), F.concat(acc["out"], F.array(got["out"])).alias("out")))

    def cut(r: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / BLOCK).cast("int")), lambda i: F.slice(r, i * BLOCK + 1, F.lit(BLOCK)))

    def placed(m: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, p, -1), F.length), 1, F.size(m))  # what follows the last match is of no use
        more = [F.regexp_extract_all(text, F.lit(p), F.lit(i)).alias(f"g{i}") for i in range(1, groups + 1)]
        rows = F.arrays_zip(gaps.alias("gap"), m.alias("m"), *more)
        if groups < 2:
            none = [F.lit(None).cast("string").alias(f"g{i}") for i in range(groups + 1, 3)]
            rows = F.transform(rows, lambda x: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), *(x[f"g{i}"].alias(f"g{i}") for i in range(1, groups + 1)), *none))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.flatten(F.aggregate(let(rows, cut), start, block, lambda acc: acc["out"]))

    return let(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(F.array().cast(SPAN)))


def blank(text: Column, p: str) -> Column:
    """Matches of p as spaces of the same length."""

    def filled(found: Column) -> Column:
        spaces = F.transform(found, lambda m: F.rpad(F.lit(" "), F.length(m), " "))
        return F.array_join(F.zip_with(F.split(text, p, -1), spaces, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return let(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda found: F.when(F.size(found) > 0, filled(found)).otherwise(text))


def around(text: Column, start: Column, end: Column, width: int) -> Column:
    """Text from width before start to width after end, as it is."""
    at = F.greatest(start - width, F.lit(0))
    return F.substring(text, at + 1, end + width - at)


def snippet(text: Column, start: Column, end: Column, width: int) -> Column:
    """The same with white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(around(text, start, end, width), SPACES, " "))


def char_to_page(offsets: Column, pos: Column) -> Column:
    """1-based page of a position: the last page that starts at or before it, as-of; 1 without pages."""
    return F.greatest(F.size(F.filter(offsets, lambda o: o <= pos)), F.lit(1))


def page_offsets(pages: Column) -> Column:
    """Where each page's text starts once pages are joined by one line feed."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(pages, zero, lambda a, p: F.struct((a["at"] + F.length(p) + 1).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


REFERENCE_HEADER = pattern(r"^\s*(?:\d+\.?\s+)?(?:references?|bibliography)\s*$", "im")


def body_text(text: Column) -> Column:
    """Text before the first line that is a references or bibliography header."""
    return F.element_at(F.split(text, REFERENCE_HEADER, 2), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def mask_superscripts(text: Column) -> Column:
    """Superscript and subscript digits as a middle dot, so they don't extend numbers."""
    return F.regexp_replace(text, "[⁰¹²³⁴-⁹₀-₉]", "·")


def quote(p: str) -> str:
    return re.escape(p)
