"""Training-data operators: recall at any size, and whole texts."""

import numpy as np
import pytest

from folioscan.llm import itq_dedup, pii, toxicity
from folioscan.llm._shared import as_long, source

DATA = "/root/testdata/sf0.1"


@pytest.mark.parametrize("largest", [200, 20_000, 1_000_000, 10_000_000])
def test_candidates_recall_at_any_width(spark, largest):
    """Planted pairs at the limit are candidates, however many classes the largest label has."""
    x = np.array([itq_dedup.unit(np.array(r.embedding, float)) for r in source(spark, DATA, "embeddings").select("embedding").collect()])
    rotation, rng = itq_dedup.learn_rotation(x), np.random.RandomState(3)
    for cosine in (0.93, 0.94, 0.95):
        u = x[rng.randint(len(x), size=1000)]
        z = rng.randn(*u.shape)
        z -= (z * u).sum(1)[:, None] * u
        v = cosine * u + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1)[:, None]
        codes = [as_long(np.packbits(w @ rotation >= 0, axis=1).view(">u8").astype(np.uint64).ravel()) for w in (u, v)]
        # Each pair has a label of its own.
        rows = [(2 * i + k, i, 64, int(codes[k][i])) for i in range(1000) for k in (0, 1)]
        got = itq_dedup.candidates(spark.createDataFrame(rows, "node long, label long, dim int, code long"), largest).collect()
        assert all(r.b == r.a + 1 and r.a % 2 == 0 for r in got) and len(got) == len(set(got))
        print(largest, cosine, len(got) / 1000)
        assert len(got) >= 970


def test_toxicity_padding_is_no_words(spark):
    """Blanks and marks between words don't lower the score that the curve was fitted for."""
    plain = "you total idiot go away " + "and so on " * 10
    padded = plain.replace(" ", " |  -- \t\n ")
    df = spark.createDataFrame([(1, plain), (2, padded)], "doc_id long, text string")
    a, b = (r.score for r in toxicity.score_documents(df, toxicity.Model()).orderBy("doc_id").collect())
    assert a == b


def test_written_emails_in_any_case(spark):
    """Neither the case of (at) nor the white space in its bracket hides a written-out address."""
    texts = ["JOHN (AT) EXAMPLE (DOT) COM", "john (\tat) example (dot) com", "john [\nAT] example.com"]
    assert [pii.proposals(t, []) for t in texts] == [[(0, 0, len(t))] for t in texts]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 20)], "doc_id long, text string")
    got = pii.find_pii(docs).collect()
    assert {r.doc_id % 3 for r in got if r.spans.startswith("email:0:")} == {0, 1, 2}
