"""Golden rows of numbering, reference, analyser, verifier, layout and streaming operators."""

import random

from pyspark.sql import functions as F

from folioscan.operators import analyser, classifier, numbering, references, structure, verify
from folioscan.sources import layout


def test_sequences(spark):
    df = spark.createDataFrame([(1, 1), (1, 3), (1, 3), (2, 1), (2, 2), (3, None)], "doc_id long, number int")
    assert sorted(tuple(r) for r in numbering.sequential(df).collect()) == [(1, "1,3,3", "2", "3", False), (2, "1,2", "", "", True)]


def test_figure_parts(spark):
    rows = [(1, 1, "(a) x, (b) y, (c) z"), (1, 2, "(a) x, (c) z"), (1, 3, "of (x)"), (1, 4, "(b) and (c)"), (1, 5, None)]
    got = numbering.figure_parts(spark.createDataFrame(rows, "doc_id long, number int, caption_text string")).collect()
    assert sorted((r.number, r.missing_parts, r.starts_at_a) for r in got) == [(2, "b", True), (4, "", False)]


def test_equation_labels_parse(spark):
    df = spark.createDataFrame([("1a",), ("A12",), ("1.2",), ("7",)], "l string")
    assert [r[0] for r in df.select(numbering.label_number(F.col("l"))).collect()] == [1, 12, None, 7]


def test_citation_numbers(spark):
    df = spark.createDataFrame([("[1,2]",), ("[3-5]",), ("[100, 100]",), ("(Smith, 2020)",), ("[1-99]",), ("[2; 4–5]",)], "m string")
    assert [r[0] for r in df.select(references.citation_numbers(F.col("m"))).collect()] == [[1, 2], [3, 4, 5], [], [2020], [], [2, 4, 5]]


def test_bidirectional(spark):
    refs = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc_id long, number int")
    cited = spark.createDataFrame([(1, 2, 4, 0), (1, 3, 5, 1), (1, 99, 6, 2), (2, 50, 1, 0)], "doc_id long, number int, page int, pos long")
    got = sorted((r.doc_id, r.type, r.number, r.page) for r in references.bidirectional(refs, cited).collect())
    assert got == [(1, "missing_from_refs", 3, 5), (1, "uncited_ref", 1, None)]  # document 2 has no citation left


def test_entries_and_continuation(spark):
    text = "Body\nReferences\n[2] Kay A. Second\n goes on\n\nnot this\n[1] Byron A. doi: 10.1/x 2001."
    got = references.entries(spark.createDataFrame([(7, text)], "doc_id long, full_text string")).orderBy("number").collect()
    assert [(r.number, r.raw_string, r.year, r.doi) for r in got] == [(1, "[1] Byron A. doi: 10.1/x 2001.", 2001, "doi:10.1/x"), (2, "[2] Kay A. Second goes on", None, None)]


def test_classifier(spark):
    samples = {
        '[1] A. Smith, "Deep learning for signals," IEEE Trans. Neural, vol. 3, pp. 12-45, 2020, doi: 10.1109/TNN.1': "IEEE",
        "Doe, J. (2019). Title of a work that goes on. Journal of Tests, 4(2), 1-9. https://doi.org/10.1000/1": "APA",
        "Roe AB, Poe CD. Short note. N Engl J Med. 2018;38(5):45-63.": "Vancouver",
        'Smith, John. "A long enough title." Journal of Things, vol. 5, no. 2, 2010, pp. 1-20.': "MLA",
        "World Health Organization (2015) Guidelines for all. Geneva: Health Press.": "Harvard",
    }
    df = spark.createDataFrame([(k,) for k in samples], "raw string").select("raw", classifier.classify(F.col("raw")).alias("c"))
    assert {r.raw: r.c.style for r in df.collect()} == samples


def test_numeric_order_skips_unlabelled(spark):
    df = spark.createDataFrame([(1, 1, "[1] a"), (1, 2, "no label"), (1, 3, "[2] b"), (1, 4, "[4] c")], "doc_id long, pos int, raw string")
    assert sorted((r.pos, r.label, r.expected) for r in analyser.numeric_order(df).collect()) == [(2, None, 2), (4, 4, 3)]


def test_casing(spark):
    df = spark.createDataFrame([("JOURNAL OF TESTS",), ("journal of tests",), ("Journal of Tests",), ("Journal of tests and things",)], "j string")
    assert [r[0] for r in df.select(analyser.casing_label(F.col("j"))).collect()] == ["ALL_CAPS", "all_lowercase", "Title Case", "Sentence case"]
    assert df.select(analyser.title_case(F.col("j"))).collect()[1][0] == "Journal of Tests"


def test_candidates_and_provider(spark):
    rows = [(1, "en_dash_ranges", 1, None, "d", "f"), (1, "acronym_definition", 1, 2, "d", "f"), (1, "unheard_of", 1, 2, "d", "f")]
    c = verify.candidates(spark.createDataFrame(rows, "doc_id long, check_id string, seq long, page int, detail string, found string"))
    assert sorted((r.candidate_id, r.category) for r in c.collect()) == [("ACRONY-001", "Structure"), ("ENDAS-002", "Formatting"), ("UNHEAR-003", "General")]
    sure, asked = verify.route(c)
    got = verify.decided(asked, verify.verify(asked, lambda b: [{"candidate_id": "1/ACRONY-001", "decision": "FALSE_POSITIVE"}]))
    assert sorted((r.candidate_id, r.decision) for r in got.collect()) == [("ACRONY-001", "FALSE_POSITIVE"), ("UNHEAR-003", "VERIFIER_FAILED")]
    assert verify.findings(got).count() == 1 and sure.first().decision == "VALID"


def test_ask_halves_and_fails():
    def small(batch):
        if len(batch) > 1:
            raise OverflowError
        return [{"candidate_id": batch[0]["candidate_id"], "decision": "VALID"}]

    assert [x["decision"] for x in verify.ask(small, [{"candidate_id": i} for i in range(3)])] == ["VALID"] * 3
    assert verify.ask(lambda b: 1 / 0, [{"candidate_id": 1}])[0]["decision"] == "VERIFIER_FAILED"
    assert verify.unwrap('```json\n{"a": [{"x": 1}]}\n```') == [{"x": 1}] and verify.unwrap("?") == []


def test_bibtex_values():
    got = layout.parse_bibtex('@article{k1, title={A {B} c}, year=2001, author = "X, Y"}\n@book{k2, note={z}} @broken{k3, a={')
    assert got == [("article", "k1", {"title": "A {B} c", "year": "2001", "author": "X, Y"}), ("book", "k2", {"note": "z"})]


def test_images_go_once(spark):
    c = spark.createDataFrame([(1, 1, 2, 500.0), (1, 2, 2, 510.0)], "doc_id long, number int, caption_page int, caption_y0 double")
    i = spark.createDataFrame([(1, 2, 10, 0.0, 300.0, 100.0, 490.0), (1, 1, 11, 0.0, 0.0, 50.0, 50.0)], "doc_id long, page_number int, img long, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.number, r.img) for r in structure.match_images(c, i).collect()) == [(1, 10), (2, 11)]


def test_images_as_one_by_one(spark):
    """As a search in plain Python, over ties, copies, small images and missing values; no Python runs for each document."""
    rng, nan = random.Random(5), float("nan")
    c = [(d, n, rng.choice([1, 2, 3, None]), rng.choice([100.0, 102.5, 300.0, 900.0, nan, None])) for d in range(60) for n in range(rng.randint(0, 5))]
    i = [(d, rng.choice([1, 2, 3, None]), rng.randint(1, 9), 0.0, rng.choice([0.0, 10.0]), rng.choice([10.0, 30.0, 60.0, nan]), rng.choice([60.0, 62.5, 90.0, 100.0])) for d in range(60) for _ in range(rng.randint(0, 9))]
    wanted = []
    for d, n, page, y0 in c:
        used = {img for e, _, img in wanted if e == d}
        able = [((x1 - x0) * (y1 - y), p, y1, img) for e, p, img, x0, y, x1, y1 in i if e == d and img not in used and (x1 - x0) * (y1 - y) >= 400]
        keys = [(round((y0 - y1) / 5), -a, img) for a, p, y1, img in able if None not in (page, y0) and p == page and y1 <= y0 and y0 - y1 <= 500]
        keys = keys or [(0, -a, img) for a, p, _, img in able if None not in (page, p) and p == page - 1]
        wanted += [(d, n, min(keys)[2])] if keys else []
    c = spark.createDataFrame(c, "doc_id long, number int, caption_page int, caption_y0 double")
    i = spark.createDataFrame(i, "doc_id long, page_number int, img long, x0 double, y0 double, x1 double, y1 double")
    got = structure.match_images(c, i)
    assert sorted(map(tuple, got.collect())) == wanted and len(wanted) > 50
    assert "Pandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.dtypes == [("doc_id", "bigint"), ("number", "int"), ("img", "bigint")]


def test_stream(spark, tmp_path):
    from folioscan.streaming import documents as stream

    spark.createDataFrame([(1, "see 10-20 now"), (2, "fine")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    got = []
    q = stream.check_stream(stream.arriving(spark, str(tmp_path / "in")), lambda rows, n: got.extend(rows.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [(r.doc_id, r.found) for r in got] == [(1, "10-20")]


def test_partition_count_doesnt_matter(spark):
    from folioscan.plans.catalog import QUERIES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(str, QUERIES["equation_sequential_numbering"](spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows[0] == rows[1]
