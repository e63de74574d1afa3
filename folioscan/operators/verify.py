"""From findings of all checks to candidates, verified findings and report issues.

A violation is (doc_id, check_id, seq, page, detail, found). The rule dimension has a fixed size and is broadcast; numbering
needs each document's rows in the checks' order, one shuffle by document.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Check id, name, category, whether it needs no verification, the detector's confidence. Order is the candidates' order.
RULES = (
    ("figure_caption_below", "Caption Positioning", "Figures", False, 0.72),
    ("table_caption_above", "Caption Positioning", "Tables", False, 0.72),
    ("figure_sequential_numbering", "Figure Numbering", "Figures", True, 0.98),
    ("table_sequential_numbering", "Table Numbering", "Tables", True, 0.98),
    ("figure_chronological_order", "Chronological Appearance", "Figures", False, 0.70),
    ("table_chronological_order", "Chronological Appearance", "Tables", False, 0.70),
    ("figure_parts_mention", "Figure Parts Mention", "Figures", False, 0.78),
    ("acronym_definition", "Acronym Definition", "Structure", False, 0.68),
    ("quote_style_consistency", "Quote Style Consistency", "Formatting", False, 0.75),
    ("english_spelling_consistency", "Spelling Consistency", "Formatting", False, 0.70),
    ("en_dash_ranges", "En-dash for Ranges", "Formatting", True, 0.95),
    ("nonbreaking_space_units", "Non-breaking Space", "Formatting", True, 0.93),
    ("no_space_percent_degree", "Percent/Degree Spacing", "Formatting", True, 0.95),
    ("double_spaces", "Double Spaces", "Formatting", True, 0.99),
    ("punctuation_spacing", "Punctuation Spacing", "Formatting", True, 0.92),
    ("style_compliance", "Style Compliance", "References", False, 0.65),
    ("bidirectional_match", "Bidirectional Citation Match", "References", False, 0.75),
    ("metadata_completeness", "Metadata Completeness", "References", False, 0.68),
    ("doi_url", "DOI / URL", "References", False, 0.70),
    ("sequential_ordering", "Sequential Ordering", "References", False, 0.80),
    ("field_consistency", "Field Consistency", "References", False, 0.65),
    ("equation_sequential_numbering", "Equation Sequential Numbering", "Equations", True, 0.98),
    ("equation_punctuation", "Equation Punctuation", "Equations", False, 0.70),
    ("in_text_reference_consistency", "In-text Reference Consistency", "Equations", False, 0.70),
)
#: A check without a rule of its own.
FALLBACK = ("General", False, 0.5)
CATEGORIES = ("References", "Figures", "Tables", "Equations", "Structure", "Language", "Formatting")
DECISIONS = ("VALID", "FALSE_POSITIVE", "UNCERTAIN", "VERIFIER_FAILED")
BATCH = 5
# Where the analyser's issues go.
ROUTES = {"journal_casing": "style_compliance", "style_conformity": "style_compliance", "completeness": "metadata_completeness", "asterikError": "metadata_completeness", "doi": "doi_url", "ordering": "sequential_ordering", "consistencyError": "field_consistency"}


def with_rules(violations: DataFrame) -> DataFrame:
    """Violations with check_name, category, skip_verifier, detector_confidence and rule_no."""
    rows = [(i, *r) for i, r in enumerate(RULES)]
    dim = F.broadcast(violations.sparkSession.createDataFrame(rows, "rule_no int, r_id string, check_name string, category string, skip_verifier boolean, detector_confidence double"))  # fixed size
    v = violations.join(dim, violations["check_id"] == dim["r_id"], "left")
    return v.select(violations["*"], F.coalesce("check_name", "check_id").alias("check_name"), F.coalesce("category", F.lit(FALLBACK[0])).alias("category"), F.coalesce("skip_verifier", F.lit(FALLBACK[1])).alias("skip_verifier"), F.coalesce("detector_confidence", F.lit(FALLBACK[2])).alias("detector_confidence"), F.coalesce("rule_no", F.lit(len(RULES))).alias("rule_no"))


def candidates(violations: DataFrame) -> DataFrame:
    """Numbered candidates of each document in the rules' order: candidate_id is the check's first six letters without underscores and a running number."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("rule_no", "check_id", "seq", "detail"))
    prefix = F.replace(F.upper(F.substring("check_id", 1, 6)), F.lit("_"), F.lit(""))
    number = n.cast("string")
    return with_rules(violations).withColumn("candidate_id", F.concat(prefix, F.lit("-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)))


def evidence(c: DataFrame) -> DataFrame:
    """candidates with evidence: array of (id, content); absent contents are empty."""
    def part(name: str, value) -> F.Column:
        return F.struct(F.lit(name).alias("id"), F.coalesce(value.cast("string"), F.lit("")).alias("content"))

    return c.withColumn("evidence", F.array(part("violation_detail", F.col("detail")), part("page", F.coalesce(F.col("page").cast("string"), F.lit("?"))), part("found", F.col("found"))))


def route(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deterministic, to verify): the first pass as VALID with the detector's confidence."""
    return c.where("skip_verifier").withColumn("decision", F.lit("VALID")).withColumn("confidence", F.col("detector_confidence")), c.where("not skip_verifier")


Provider = Callable[[list[dict]], list[dict]]


def ask(provider: Provider, batch: list[dict], retries: int = 3) -> list[dict]:
    """Decisions of a batch: retried, halved when the provider says it is too large, failed when it stays without an answer."""
    for _ in range(retries):
        try:
            return provider(batch)
        except OverflowError:
            if len(batch) > 1:
                half = len(batch) // 2
                return ask(provider, batch[:half], retries) + ask(provider, batch[half:], retries)
        except Exception:  # noqa: BLE001  whatever a provider raises counts as one failed try
            continue
    return [{"candidate_id": x["candidate_id"], "decision": "VERIFIER_FAILED"} for x in batch]


def verify(c: DataFrame, provider: Provider) -> DataFrame:
    """Decisions (doc_id, candidate_id, decision, confidence) by a provider, BATCH candidates a call, inside the workers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for at in range(0, len(f), BATCH):
                part = f.iloc[at : at + BATCH]
                # A batch may hold several documents, whose candidate ids repeat.
                asked = [{**r, "candidate_id": f"{r['doc_id']}/{r['candidate_id']}"} for r in part.to_dict("records")]
                got = {x.get("candidate_id"): x for x in ask(provider, asked)}
                for r in part.itertuples():
                    x = got.get(f"{r.doc_id}/{r.candidate_id}", {})
                    decision = x.get("decision", "VERIFIER_FAILED")
                    rows.append((r.doc_id, r.candidate_id, decision if decision in DECISIONS else "UNCERTAIN", float(x.get("confidence", 0.5))))
            yield pd.DataFrame(rows, columns=["doc_id", "candidate_id", "decision", "confidence"])

    return c.select("doc_id", "candidate_id", "check_id", "detail").mapInPandas(run, "doc_id long, candidate_id string, decision string, confidence double")


def unwrap(raw: str) -> list[dict]:
    """The list of decisions in a model's answer: fences stripped, the first list inside an object; [] if it isn't JSON."""
    try:
        got = json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", raw.strip()))
    except ValueError:
        return []
    if isinstance(got, dict):
        got = next((v for v in got.values() if isinstance(v, list)), [])
    return [x for x in got if isinstance(x, dict)] if isinstance(got, list) else []


def unwrapped(raw: Column) -> Column:
    """unwrap() of a column: each decision as JSON."""

    def run(answers: pd.Series) -> pd.Series:
        return answers.map(lambda a: [] if a is None else [json.dumps(x) for x in unwrap(a)])

    return F.pandas_udf(run, "array<string>")(raw)


def decided(c: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with their decision; VERIFIER_FAILED and 0.5 where none came back."""
    d = decisions.select("doc_id", "candidate_id", "decision", "confidence")
    return c.join(d, ["doc_id", "candidate_id"], "left").withColumn("decision", F.coalesce("decision", F.lit("VERIFIER_FAILED"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))


def findings(d: DataFrame) -> DataFrame:
    """Decided candidates but for false positives; severity is error only for valid ones."""
    f = d.where("decision <> 'FALSE_POSITIVE'").withColumn("severity", F.when(F.col("decision") == "VALID", "error").otherwise("warning"))
    return f.select("doc_id", "candidate_id", "check_id", "category", F.col("check_name").alias("title"), "decision", "confidence", "severity", "page")


def issues(rows: DataFrame) -> DataFrame:
    """Findings or violations with a category -> issues numbered over the document: issue_id is the category's first three letters and a running number."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("rule_no", "check_id", "seq")).cast("string")
    return rows.select("doc_id", F.concat(F.upper(F.substring("category", 1, 3)), F.lit("-"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)).alias("issue_id"), "category", F.col("check_name").alias("title"), "page")


def by_category(i: DataFrame) -> DataFrame:
    """Issues of each document in each category, in the report's order, zeros included."""
    dim = F.broadcast(i.sparkSession.createDataFrame(list(enumerate(CATEGORIES)), "pos int, category string"))  # fixed size
    docs = i.select("doc_id").distinct().crossJoin(dim)  # seven rows a document
    return docs.join(i.groupBy("doc_id", "category").agg(F.count("*").alias("n")), ["doc_id", "category"], "left").select("doc_id", "pos", "category", F.coalesce("n", F.lit(0)).alias("n"))


def search_text(evidence: F.Column) -> F.Column:
    """What to look for on the page: a quoted text, else a figure, table or [n], else a fragment of 60 characters."""
    quoted = F.nullif(F.regexp_extract(evidence, '"([^"]{3,})"', 1), F.lit(""))
    named = F.nullif(F.regexp_extract(evidence, r"((?:Figure|Table)\s+\d+|\[\d+\])", 1), F.lit(""))
    return F.coalesce(quoted, named, F.substring(evidence, 1, 60))


def routed(rows: DataFrame) -> DataFrame:
    """Analyser issues (doc_id, pos, check) -> the output they belong to; unknown checks are dropped."""
    out = F.lit(None).cast("string")
    for check, to in ROUTES.items():
        out = F.when(F.col("check") == check, to).otherwise(out)
    return rows.withColumn("output", out).where("output is not null")
