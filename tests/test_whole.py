"""Queries cover every row and the whole text of their tables."""

import os
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscan.plans import report_queries
from folioscan.plans.catalog import ORACLES, QUERIES
from folioscan.sources.manuscripts import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as from read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return con


def rows_of(df, rel):
    columns = sorted(df.columns)
    at = [list(rel.columns).index(c) for c in columns]
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect()), sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["completeness_fields", "reference_quality_issues", "all_quality_issues"])
def test_every_order(spark, duck, name):
    sql = ORACLES[name].replace(" where o_orderkey % 3 = 0", "")
    got, wanted = rows_of(QUERIES[name](spark, DATA), duck.sql(sql))
    assert got == wanted and {int(r[3]) % 3 for r in got} == {0, 1, 2}  # pos is the fourth column of each


def test_every_document_is_matched(spark, duck):
    got = {r.doc_id for r in QUERIES["image_caption_match"](spark, DATA).collect()}
    # A document with an image above a caption on its page, within 500 points, or on the page before, has a match.
    wanted = duck.sql("""with c as (select l_orderkey as doc_id, min(l_partkey % 3 + 1) as page, min(l_suppkey * 7.0 % 700) as y0 from lineitem group by l_orderkey, l_linenumber),
      i as (select l_orderkey as doc_id, l_suppkey % 3 + 1 as at, l_quantity * 8 + 60 as y1 from lineitem)
      select distinct c.doc_id from c join i on c.doc_id = i.doc_id and (i.at = c.page and i.y1 <= c.y0 and c.y0 - i.y1 <= 500 or i.at = c.page - 1)""").fetchall()
    assert got == {r[0] for r in wanted} and {d % 5 for d in got} == {0, 1, 2, 3, 4}


def test_every_label_is_parsed(spark, duck):
    sql = ORACLES["equation_label_parse"].replace(" where l_linenumber = 1", "")
    got, wanted = rows_of(QUERIES["equation_label_parse"](spark, DATA), duck.sql(sql))
    assert got == wanted and len(got) == duck.sql("select count(*) from lineitem").fetchall()[0][0]


@pytest.mark.parametrize("name", ["highlight_spans"])
def test_first_occurrence(spark, duck, name):
    """As the SQL, over all words in place of the last 80."""
    sql = ORACLES[name].replace("w[greatest(len(w) - 79, 1):]", "w")
    got, wanted = rows_of(QUERIES[name](spark, DATA), duck.sql(sql))
    assert got == wanted and max(int(r[1]) for r in got) > 80


def test_highlights_early_words(spark):
    texts = ["so (DOE,  J.\n(2019)) said " + "more " * 100 + "Doe, J. (2019).", "Doe, J. (2019) " + "x " * 90, "İİ Doe, J. (2019)!", "x " * 90, None, "", "Doe, J. (2018)"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, full_text string")
    got = sorted(tuple(r) for r in report_queries.highlighted(df, "doe, j. (2019)").collect())
    assert got == [(0, 1, "(DOE,"), (0, 2, "J."), (0, 3, "(2019))"), (1, 0, "Doe,"), (1, 1, "J."), (1, 2, "(2019)"), (2, 1, "Doe,"), (2, 2, "J."), (2, 3, "(2019)!")]


def test_accents_fold_as_by_decomposition(spark):
    """Marks of any letter go; what isn't a letter with marks stays."""
    from folioscan.operators import analyser

    words = ["García", "Erdős", "Şahin", "Āboliņš", "Łukasz", "Nguyễn", "İnci", "e\u0301clair", "Ångström", "Żółw", "Ｆull", "ø"]
    want = ["".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)).lower() for w in words]
    df = spark.createDataFrame(list(enumerate(words)), "i int, w string")
    assert [r.f for r in df.select("i", analyser.fold_accents(F.col("w")).alias("f")).orderBy("i").collect()] == want


def test_unwrapped_answers(spark):
    from folioscan.operators.verify import unwrapped

    raws = ['```json\n[{"a": 1}]\n```', '{"n": 1, "results": [{"a": 1}, 2, {"b": 2}]}', "no json", None, '[[1], {"a": {"b": [1]}}]', "7", '{"a": {"b": []}}']
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    assert [r.n for r in df.select("i", F.size(unwrapped(F.col("raw"))).alias("n")).orderBy("i").collect()] == [1, 2, 0, 0, 1, 0, 0]
