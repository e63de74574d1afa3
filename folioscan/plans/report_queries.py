"""Queries from violations to the report, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import verify as V
from folioscan.sources.manuscripts import manuscripts, select

from . import duck as D
from .text_queries import GRAMMAR, O as TEXT, Q as TEXT_Q

Q, O = {}, {}
# Violations of every rule and of one unknown check, by the line's numbers.
_IDS = ", ".join(D.lit(r[0]) for r in V.RULES) + ", 'unheard_of'"
_N = len(V.RULES) + 1
VIOLATIONS = f"""select l_orderkey as doc_id, element_at(array({_IDS}), cast((l_partkey + l_linenumber) % {_N} as int) + 1) as check_id, l_partkey * 100000 + l_suppkey * 10 + l_linenumber as seq, case when l_suppkey % 3 = 0 then null else month(l_shipdate) end as page,
  concat('Detail "quoted ', cast(l_partkey as varchar(9)), '" of Figure ', cast(l_linenumber as varchar(9))) as detail, case when l_partkey % 2 = 0 then null else 'found it' end as found from lineitem"""
DUCK = VIOLATIONS.replace("element_at(array(", "([").replace("), cast((", "])[cast((").replace(" as int) + 1)", " as int) + 1]")
_DIM = "(values " + ", ".join(f"({i}, {D.lit(r[0])}, {D.lit(r[1])}, {D.lit(r[2])}, {str(r[3]).lower()}, {r[4]}::double)" for i, r in enumerate(V.RULES)) + ") dim(rule_no, r_id, r_name, r_category, r_skip, r_confidence)"
_RULED = f"""v as ({DUCK}), w as (select v.*, coalesce(r_name, check_id) as check_name, coalesce(r_category, 'General') as category, coalesce(r_skip, false) as skip_verifier, coalesce(r_confidence, 0.5::double) as detector_confidence, coalesce(rule_no, {len(V.RULES)}) as rule_no from v left join {_DIM} on check_id = r_id),
n as (select *, row_number() over (partition by doc_id order by rule_no, check_id, seq) as i from w),
c as (select *, replace(upper(substr(check_id, 1, 6)), '_', '') || '-' || case when i < 100 then lpad(i::varchar, 3, '0') else i::varchar end as candidate_id from n)"""
# A fake provider's decisions, by arithmetic on the candidate's number; every ninth stays without an answer.
_DECIDED = """d as (select *, case when skip_verifier then 'VALID' when seq % 9 = 0 then 'VERIFIER_FAILED' when seq % 4 = 0 then 'FALSE_POSITIVE' when seq % 4 = 1 then 'UNCERTAIN' else 'VALID' end as decision, case when skip_verifier then detector_confidence when seq % 9 = 0 then 0.5::double else 0.9::double end as confidence from c)"""


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, VIOLATIONS, "lineitem")


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure, asked = V.route(V.candidates(violations(spark, sf_dir)))
    decision = F.when(F.col("seq") % 4 == 0, "FALSE_POSITIVE").when(F.col("seq") % 4 == 1, "UNCERTAIN").otherwise("VALID")
    answers = asked.where("seq % 9 <> 0").select("doc_id", "candidate_id", decision.alias("decision"), F.lit(0.9).alias("confidence"))
    return sure.unionByName(V.decided(asked, answers))


def add(name, run, sql):
    Q[name], O[name] = run, f"with {_RULED}, {_DECIDED} {sql}"


cols = ("doc_id", "candidate_id", "check_id", "check_name", "category", "skip_verifier", "detector_confidence", "page")
add("rule_dim_join", lambda s, d: V.with_rules(violations(s, d)).select("doc_id", "seq", "check_id", "check_name", "category", "skip_verifier", "detector_confidence"), "select doc_id, seq, check_id, check_name, category, skip_verifier, detector_confidence from w")
add("build_candidates", lambda s, d: V.candidates(violations(s, d)).select(*cols), f"select {', '.join(cols)} from c")
add("candidate_id", lambda s, d: V.candidates(violations(s, d)).select("doc_id", "seq", "candidate_id"), "select doc_id, seq, candidate_id from c")
add("candidate_evidence", lambda s, d: V.evidence(V.candidates(violations(s, d))).select("doc_id", "candidate_id", F.array_join(F.transform("evidence", lambda e: F.concat(e["id"], F.lit("="), e["content"])), "|").alias("evidence")), "select doc_id, candidate_id, 'violation_detail=' || detail || '|page=' || coalesce(page::varchar, '?') || '|found=' || coalesce(found, '') as evidence from c")
add("route_deterministic", lambda s, d: V.route(V.candidates(violations(s, d)))[0].select("doc_id", "candidate_id", "decision", "confidence"), "select doc_id, candidate_id, decision, confidence from d where skip_verifier")
add("match_decisions", lambda s, d: decided(s, d).select("doc_id", "candidate_id", "decision", "confidence"), "select doc_id, candidate_id, decision, confidence from d")
add("build_findings", lambda s, d: V.findings(decided(s, d)).select("doc_id", "candidate_id", "check_id", "title", "decision"), "select doc_id, candidate_id, check_id, check_name as title, decision from d where decision <> 'FALSE_POSITIVE'")
add("findings_projection", lambda s, d: V.findings(decided(s, d)), "select doc_id, candidate_id, check_id, category, check_name as title, decision, confidence, case decision when 'VALID' then 'error' else 'warning' end as severity, page from d where decision <> 'FALSE_POSITIVE'")
_ISSUE = "upper(substr(category, 1, 3)) || '-' || case when i < 100 then lpad(i::varchar, 3, '0') else i::varchar end as issue_id"
add("report_issues", lambda s, d: V.issues(V.with_rules(violations(s, d))), f"select doc_id, {_ISSUE}, category, check_name as title, page from c")
_CATS = "(values " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(V.CATEGORIES)) + ") cat(pos, category)"
add("issues_by_category", lambda s, d: V.by_category(V.issues(V.with_rules(violations(s, d)))), f", g as (select doc_id, category, count(*) as n from c group by all) select b.doc_id, b.pos, b.category, coalesce(n, 0) as n from (select * from (select distinct doc_id from c) cross join {_CATS}) b left join g using (doc_id, category)".replace(", g as", ", g as", 1))
O["issues_by_category"] = O["issues_by_category"].replace(_DECIDED + " ,", _DECIDED + ",")
add("issue_search_text", lambda s, d: violations(s, d).select("doc_id", "seq", V.search_text(F.col("detail")).alias("needle")), "select doc_id, seq, regexp_extract(detail, '\"([^\"]{3,})\"', 1) as needle from v")


def missing_keywords(spark, sf_dir):
    m = manuscripts(spark, sf_dir)
    return m.where(~F.col("body").rlike(T.pattern(r"^\s*(?:keywords?|index\s+terms?|key\s+words?)\b", "im"))).select("doc_id")


Q["missing_keywords"] = missing_keywords
O["missing_keywords"] = rf"with {D.BODY} select doc_id from d where not regexp_matches(body, '(?im)^\s*(?:keywords?|index\s+terms?|key\s+words?)\b')"


def highlighted(m: DataFrame, needle: str) -> DataFrame:
    """(doc_id, pos, word): words of full_text that the first occurrence of needle covers; pos counts words from 0. needle is in lower case, without blanks at its ends.

    A word's number is the number of blanks before it in the words joined by blanks, so no offsets are kept for each word.
    """
    m = m.withColumn("w", T.words(F.col("full_text"))).withColumn("before", F.split(F.lower(F.array_join("w", " ")), T.quote(needle), 2)).where("size(before) = 2")
    first = F.size(F.split(F.col("before")[0], " ")) - 1
    rows = m.select("doc_id", first.alias("first"), F.posexplode(F.slice("w", first + 1, needle.count(" ") + 1)).alias("i", "word"))
    return rows.select("doc_id", (F.col("first") + F.col("i")).alias("pos"), "word")


def highlight_spans(spark, sf_dir):
    """Words of a page that the first occurrence of a search text covers."""
    return highlighted(manuscripts(spark, sf_dir), "doe, j. (2019)")


Q["highlight_spans"] = highlight_spans
O["highlight_spans"] = rf"""with {D.BODY}, a as (select doc_id, list_filter(string_split_regex(full_text, '\s+'), lambda x: x <> '') as w from d),
c as (select *, array_to_string(w, ' ') as t, instr(lower(array_to_string(w, ' ')), 'doe, j. (2019)') - 1 as st from a),
e as (select doc_id, w, unnest(range(length(regexp_replace(substr(t, 1, st), '[^ ]', '', 'g')), length(regexp_replace(substr(t, 1, st + 14), '[^ ]', '', 'g')) + 1)) as pos from c where st >= 0)
select doc_id, pos, w[pos + 1] as word from e"""
ISSUES = "select o_custkey as doc_id, o_orderkey as pos, element_at(array('journal_casing', 'style_conformity', 'completeness', 'asterikError', 'doi', 'ordering', 'consistencyError', 'other'), cast(o_orderkey % 8 as int) + 1) as check from orders"
Q["reference_checks_route"] = lambda s, d: V.routed(select(s, d, ISSUES.replace(" as check ", " as check_ "), "orders").withColumnRenamed("check_", "check")).select("doc_id", "pos", "output")
O["reference_checks_route"] = "select o_custkey as doc_id, o_orderkey as pos, (['style_compliance', 'style_compliance', 'metadata_completeness', 'metadata_completeness', 'doi_url', 'sequential_ordering', 'field_consistency'])[o_orderkey % 8 + 1] as output from orders where o_orderkey % 8 < 7"


def document_summary(spark, sf_dir):
    """Findings of each check of each document that has any, and how many of its checks pass."""
    out = None
    for n in ("en_dash_ranges", "nonbreaking_space_units", "no_space_percent_degree"):
        rows = TEXT_Q[n](spark, sf_dir).select("doc_id", "check_id")
        out = rows if out is None else out.union(rows)
    g = out.groupBy("doc_id").agg(F.count("*").alias("findings"), F.countDistinct("check_id").alias("failed"))
    return g.select("doc_id", "findings", "failed", (3 - F.col("failed")).alias("passed"))


Q["document_summary"] = document_summary
O["document_summary"] = "with f as (" + " union all ".join(f"select doc_id, check_id from ({TEXT[n]})" for n in ("en_dash_ranges", "nonbreaking_space_units", "no_space_percent_degree")) + ") select doc_id, count(*) as findings, count(distinct check_id) as failed, 3 - count(distinct check_id) as passed from f group by doc_id"


def verify_with_fake(spark, sf_dir):
    """Batched verification by a provider that stands for a language model."""

    def provider(batch):
        return [{"candidate_id": x["candidate_id"], "decision": "VALID" if len(x["detail"]) % 2 else "FALSE_POSITIVE", "confidence": 0.9} for x in batch]

    return V.verify(V.route(V.candidates(violations(spark, sf_dir)))[1], provider)


Q["verify_batches"] = verify_with_fake
O["verify_batches"] = f"with {_RULED} select doc_id, candidate_id, case when length(detail) % 2 = 1 then 'VALID' else 'FALSE_POSITIVE' end as decision, 0.9::double as confidence from c where not skip_verifier"
