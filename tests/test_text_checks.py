"""Golden rows and differential tests of the text checks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import text_checks as C


def run(spark, name, *bodies):
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string")
    return sorted((r.doc_id, r.seq, r.pos, r.found, r.correct) for r in C.run(C.CHECKS[name], docs).collect())


def test_spans_agree_with_re(spark):
    rng = random.Random(3)
    texts = ["", "a1", "😀 12-3é 4--5", *("".join(rng.choice("ab1 2-é–.\n😀") for _ in range(400)) for _ in range(20))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for p in (r"\d+", r"(\w)-(\d)", r"\s+", r"(?<!\w)(\d+)-(\d+)(?!\w)"):
        got = {r.i: [(s.start, s.end, s.found) for s in r.s] for r in df.select("i", T.spans(F.col("t"), T.pattern(p), 2 if "(\\d" in p or "(\\w" in p else 0).alias("s")).collect()}
        assert got == {i: [(m.start(), m.end(), m.group()) for m in re.finditer(p, t)] for i, t in enumerate(texts)}


def test_dashes(spark):
    got = run(spark, "en_dash_ranges", "10-20 kHz, 3--7, 10-20 again", "see [23-25] and doi:10.1109/NET.2021.3050-3070", "", None, "x10-20y")
    assert got == [(0, 1, 0, "10-20", "10–20"), (0, 2, 11, "3--7", "3–7")]


def test_units_need_exact_case_and_boundary(spark):
    assert [x[3] for x in run(spark, "nonbreaking_space_units", "10kg 3ms 5KG Fig. 4b 100MHz2 7mWx 8mW.")] == ["10kg", "3ms", "8mW"]
    assert run(spark, "no_space_percent_degree", "10 % and 90 °C")[0][4] == "10%"


@pytest.mark.parametrize("n,expected", [(25, 25), (26, 25), (24, 24)])
def test_cap(spark, n, expected):
    assert len(run(spark, "nonbreaking_space_units", " ".join(f"{i}kg" for i in range(n)))) == expected


def test_a_later_rule_may_still_add_one(spark):
    got = run(spark, "en_dash_ranges", " ".join(f"{i}-{i + 1}" for i in range(1, 90, 2)) + " 1--2 and 3--4")
    assert len(got) == 26 and got[-1][3] == "1--2"


def test_punctuation_once_in_a_bucket(spark):
    assert len(run(spark, "punctuation_spacing", "a , b , c" + " " * 200 + "d , e")) == 2


def test_acronyms(spark):
    bodies = ["Wireless Sensor Network (WSN) uses WSN.", "QXZ is odd.", "WSN first. Wireless Sensor Network (WSN).", "QRS (quick red stop) and QRS", "Self-Learning Box (SLB) SLB", "(QXY) only"]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string")
    assert sorted((r.doc_id, r.found, r.kind) for r in C.acronyms(docs).collect()) == [(1, "QXZ", "never_defined"), (2, "WSN", "used_before")]


def test_spelling_and_quotes(spark):
    docs = spark.createDataFrame([(0, "Color and colour; centre"), (1, 'a "b" “c”'), (2, None), (3, '"x" ‘y’')], "doc_id long, body string")
    assert [(r.doc_id, r.american) for r in C.spelling(docs).collect()] == [(0, "color")]
    assert sorted((r.doc_id, r.kind) for r in C.quote_style(docs).collect()) == [(1, "mixed_double_quotes"), (3, "mixed_single_and_straight_double")]


def test_page_lookup(spark):
    df = spark.createDataFrame([(["abc", "de", ""],)], "p array<string>").select(T.page_offsets(F.col("p")).alias("o"))
    pages = df.select(F.transform(F.array(*map(F.lit, (0, 3, 4, 6, 7, 99))), lambda x: T.char_to_page(F.col("o"), x)).alias("p")).first().p
    assert pages == [1, 1, 2, 2, 3, 3]
