"""Pages, blocks and bibliographies as sources, and result sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pages(docs: DataFrame, size: int = 40) -> DataFrame:
    """(doc_id, full_text) -> pages of size lines: doc_id, page_number (from 1), plain_text."""
    lines = docs.select("doc_id", F.split("full_text", "\n").alias("l"))
    n = F.ceil(F.size("l") / size).cast("int")
    return lines.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(F.col("l"), i * size + 1, F.lit(size)), "\n"))).alias("p", "plain_text")).select("doc_id", (F.col("p") + 1).alias("page_number"), "plain_text")


def page(p: DataFrame, number: int) -> DataFrame:
    """One page of each document; page numbers start at 1."""
    if number < 1:
        raise ValueError("page numbers start at 1")
    return p.where(F.col("page_number") == number)


def plain_text(lines: Column) -> Column:
    """An array of lines as text: stripped, blank ones dropped."""
    return F.array_join(F.filter(F.transform(lines, lambda l: F.regexp_replace(l, r"(?U)^\s+|\s+$", "")), lambda l: l != ""), "\n")


def bold(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(16)) != 0


def italic(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(2)) != 0


def kept_boxes(boxes: Column) -> Column:
    return F.filter(boxes, lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Text and image blocks (type 0 and 1) of a page by tens of points down, rounded half to even, then from the left; seq from 1."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page_number").orderBy(F.bround(F.col("y0") / 10), "x0", "block_no")
    return blocks.where("type in (0, 1)").withColumn("seq", F.row_number().over(w))


def search(p: DataFrame, queries: DataFrame, most: int = 20) -> DataFrame:
    """Exact occurrences of queries(query) in pages, white space of the query collapsed, blank queries none, most of each query and document: doc_id, query, page_number, pos, hit.

    queries come from the caller and are few; they are broadcast after a check.
    """
    from pyspark.sql import Window

    q = queries.select(F.trim(F.regexp_replace("query", r"(?U)\s+", " ")).alias("query")).where("query <> ''").distinct()
    q = F.broadcast(q) if q.count() <= 100_000 else q
    found = p.join(q, F.contains("plain_text", "query"))
    parts = F.split("plain_text", F.concat(F.lit(r"\Q"), "query", F.lit(r"\E")), -1)
    rows = found.select("doc_id", "query", "page_number", F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("i", "gap"))
    w = Window.partitionBy("doc_id", "query", "page_number").orderBy("i")
    rows = rows.withColumn("pos", F.sum(F.length("gap")).over(w) + F.col("i") * F.length("query"))
    return rows.withColumn("hit", F.row_number().over(Window.partitionBy("doc_id", "query").orderBy("page_number", "pos"))).where(F.col("hit") <= most).select("doc_id", "query", "page_number", "pos", "hit")


ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s]+)\s*,")


def parse_bibtex(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(type, id, fields) of each entry; values in braces, quotes or bare; an entry that never closes ends the list."""
    out, at = [], 0
    while m := ENTRY.search(text, at):
        fields, i = {}, m.end()
        while i < len(text):
            f = re.compile(r"\s*,?\s*(\w+)\s*=\s*").match(text, i)
            if not f:
                break
            i = f.end()
            if text[i : i + 1] in ("{", '"'):
                close, depth, j = "}" if text[i] == "{" else '"', 0, i + 1
                while j < len(text) and (depth or text[j] != close):
                    depth += (text[j] == "{") - (text[j] == "}")
                    j += 1
                value, i = text[i + 1 : j], j + 1
            else:
                v = re.compile(r"[^,}\s]*").match(text, i)
                value, i = v.group(), v.end()
            fields[f.group(1).lower()] = " ".join(value.split())
        end = text.find("}", i)
        if end < 0:
            break
        out.append((m.group(1).lower(), m.group(2), fields))
        at = end + 1
    return out


def bibtex(files: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, pos, entry_type, entry_id, entry (map of fields)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, i, t, k, e) for d, text in zip(f.doc_id, f.text) for i, (t, k, e) in enumerate(parse_bibtex(text or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "entry_type", "entry_id", "entry"])

    return files.select("doc_id", "text").mapInPandas(run, "doc_id long, pos int, entry_type string, entry_id string, entry map<string,string>")


GROBID = "refBibs array<struct<rawForm:string,teiText:string,note:string,pos:array<struct<p:int,x:double,y:double,w:double,h:double>>>>, pages array<struct<page_height:double>>"


def grobid(raw: Column) -> Column:
    """A service's JSON answer; null fields where it is malformed."""
    return F.from_json(raw, GROBID, {"mode": "PERMISSIVE"})


def raw_string(raw_form: Column, tei: Column, note: Column) -> Column:
    """rawForm, else the TEI without tags if longer than 20 characters, else the note if longer than 20."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(tei, r"<[^>]+>", " "), r"(?U)\s+", " "))
    return F.coalesce(F.nullif(F.trim(raw_form), F.lit("")), F.when(F.length(plain) > 20, plain), F.when(F.length(F.trim(note)) > 20, F.trim(note)))


def flip(page_height: Column, y: Column, h: Column) -> Column:
    """Top of a box whose y runs upwards, in coordinates that run downwards; 792 points where the height is unknown."""
    return F.coalesce(page_height, F.lit(792.0)) - y - h


def errors(files: DataFrame) -> DataFrame:
    """Unreadable files (null text): doc_id, error, extraction_errors as JSON. They take part in no check."""
    reason = F.lit("unreadable")
    return files.where("text is null").select("doc_id", reason.alias("error"), F.to_json(F.array(F.struct(F.lit(0).alias("page"), reason.alias("reason")))).alias("extraction_errors"))


def result_json(violations: DataFrame) -> DataFrame:
    """One JSON object a document: its violations in order."""
    return violations.groupBy("doc_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("check_id", "seq", "found")))).alias("result"))


def pdf_files(spark, path: str) -> DataFrame:
    """A folder of PDF files as (path, content); parsing them is left to a parser given to mapInPandas."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
