"""Toxicity, PII, secrets, chat and packing against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscan.llm import chat, packing, pii, queries, secret_scan, toxicity
from folioscan.llm._shared import source

DATA = "/root/testdata/sf0.01"
ENCODER, PLAIN = packing.Encoder(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string"  # the last two clash with results
ODD = [
    (1, None, "en", None, 0, 0.5, "x"), (2, "", "en", "a", 0, 0.5, "x"), (None, "you 1d10t, total scum", "en", "a", 0, 0.5, "x"), (4, "word " * 50_000, None, "a", 0, None, None),
    (5, "same text a@b.co", "en", "b", 0, 0.5, "x"), (5, "same text a@b.co", "en", "b", 0, 0.5, "x"), (6, "ΙDΙOT token = \"abcdefgh12\" 日本", "en", "b", 0, 0.5, "x"),
]


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_toxicity_held_out(spark):
    rows = queries.op1_toxicity(spark, DATA).join(source(spark, DATA, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert right > 0.93 and all(0 <= r.score <= 1 for r in rows)
    assert not any(r.predicted and not r.toxic for r in rows)


def test_toxicity_folds_and_exempts(spark, odd, none):
    got = sorted(((r.doc_id, r.predicted, r.terms) for r in toxicity.score_documents(odd, toxicity.Model()).collect()), key=str)
    assert [g for g in got if g[1]] == [(6, 1, "idiot:0:5"), (None, 1, "idiot:4:9 scum:17:21")]
    assert len(got) == len(ODD) and toxicity.score_documents(none, toxicity.Model()).count() == 0
    m = toxicity.Model()
    assert toxicity.hits(m.automaton(), toxicity.fold("pond scum on a trash can")) == [] and toxicity.fold("A$$ $5 l33t") == "a    s ieet"
    assert toxicity.reject_toxic(odd, m).count() == 5 and toxicity.reject_toxic(odd, m).columns == odd.columns
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(odd, empty).terms == m.terms


def brute_pii(t):
    out = []
    for k, (kind, p) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((k, m.start(), m.end(), kind))
    return [f"{kind}:{s}:{e}" for _, s, e, kind in sorted(out)]


def test_pii_base_spans(spark):
    texts = {r.doc_id: r.text or "" for r in source(spark, DATA, "documents").collect()}
    for r in queries.op2_pii(spark, DATA).collect():
        base = brute_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) if base else True
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b.startswith(k + ":") for b in base) for k in ("email", "ip", "card", "phone"))


@settings(max_examples=500, deadline=None)
@given(st.text("aZ0192.@-+_% ()x", max_size=40) | st.text("0159.", max_size=25))
def test_base_spans_are_the_patterns(text):
    assert [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(pii.base_spans(text))] == brute_pii(text)


def test_pii_takes_time_in_proportion():
    """Long runs of what a pattern may begin with don't make a search start over at each character."""
    n = 1_000_000
    for text in ("1" * n + "@", "a" * n + "@b", "." * n + "@", "1." * (n // 2), "a(at)" * (n // 5), "0" * 5000 + ".1.1.1", "+1" + "(" * n, "4111 1111 1111 1111 " * (n // 20)):
        began = time.time()
        pii.proposals(text, pii.base_spans(text))
        assert time.time() - began < 5
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(1, 0, 5006)]


def test_pii_adds_and_leaves_alone(spark, odd, none):
    rows = [(i, f"Pay by card 4111 1111 1111 1111 4242424242424242 now, mail joe{i}@x.com or call +1 (743) 555-3824") for i in range(20)] + [(99, "Nothing here, version 1.2.3 of 2020.")]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_card == 0 and got[0].spans.count("card:") == 2  # the run of 32 digits fails as a whole, its cards are added
    assert got[99].spans == "" and got[99].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert sorted(r.n_email for r in pii.find_pii(odd).collect()) == [0, 0, 0, 0, 0, 1, 1] and pii.find_pii(none).count() == 0


def test_secrets_edge_cases(spark, odd, none):
    got = sorted((str(r.doc_id), r.n_assign, r.spans) for r in secret_scan.secrets_report(odd).collect())
    assert [g for g in got if g[1]] == [("6", 1, "assign:6:25")] and len(got) == len(ODD)
    assert secret_scan.secrets_report(none).count() == 0
    t = "Token=token:abcdef PASSWORD: 'hunter22' ſecret=abcdefgh AKIA" + "A" * 16 + " " + "0f" * 12
    r = secret_scan.secrets_report(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert r.spans == "assign:19:38,access:56:76,hex:77:101" and r.n_assign == 1


def test_ledger_scans_unseen_only(spark):
    a = spark.createDataFrame([("p1", "password=abcdef1"), ("p2", "password=abcdef1"), ("p3", "clean")], "path string, text string")
    first, ledger, found = secret_scan.scan(a, ["path"])
    assert ledger.count() == 2 and found.count() == 1 and sorted(r.path for r in first.collect() if r.spans) == ["p1", "p2"]
    fake = found.withColumn("spans", found["spans"])  # what the ledger has isn't scanned again: findings are taken from it
    b = a.union(spark.createDataFrame([("p4", "secret: zzzzzz9"), ("p5", "password=abcdef1")], a.schema))
    second, ledger2, found2 = secret_scan.scan(b, ["path"], ledger=ledger, findings=fake.limit(0))
    assert sorted(r.path for r in second.collect() if r.spans) == ["p4"] and ledger2.count() == 3 and found2.count() == 1
    third, _, _ = secret_scan.scan(b, ["path"], ledger=ledger, findings=found)
    assert sorted(r.path for r in third.collect() if r.spans) == ["p1", "p2", "p4", "p5"]


def test_ledger_is_kept(spark, tmp_path, none):
    """Increments through a stored ledger: what one has scanned the next reads, whatever its path."""
    ledger = secret_scan.BlobLedger(spark, f"file://{tmp_path}/ledger")
    a = spark.createDataFrame([("p1", "password=abcdef1"), ("p2", "password=abcdef1"), ("p2", "password=abcdef1"), (None, None)], "path string, text string")
    assert sorted(r.path for r in ledger.scan(a, ["path"]).collect() if r.spans) == ["p1", "p2", "p2"]
    assert ledger.read("blobs").count() == 2 and ledger.read("findings").count() == 1
    b = a.union(spark.createDataFrame([("p9", "secret: zzzzzz9"), ("p5", "password=abcdef1")], a.schema))
    assert sorted(r.path for r in ledger.scan(b, ["path"]).collect() if r.spans) == ["p1", "p2", "p2", "p5", "p9"]
    assert ledger.read("blobs").count() == 3 and ledger.read("findings").count() == 2
    assert ledger.scan(b, ["path"], secret_scan.RULES[:1]).count() == 6 and ledger.read("blobs").count() == 6  # other rules see all blobs again
    assert ledger.scan(a.limit(0), ["path"]).count() == 0


@pytest.mark.parametrize("few", [0, 2, 10**6])
def test_rows_to_scan_by_any_list(spark, monkeypatch, few):
    monkeypatch.setattr(secret_scan, "BROADCAST_ROWS", few * 32)
    rows = [(f"p{i}", f"token={i % 7:06d}") for i in range(40)]
    df = spark.createDataFrame(rows, "path string, text string")
    got = secret_scan.scan(df, ["path"])
    assert got[2].count() == 7 and got[1].count() == 7 and all(len(r.spans) == 1 for r in got[0].collect())


@pytest.mark.parametrize("blanks", [True, False])
def test_chat_recovers_roles(spark, blanks):
    """With and without the blank line that ends a turn."""
    turns = source(spark, DATA, "conversations")
    lines = chat.transcripts(turns)
    turn_of = {(r.conv_id, r.pos): r.turn for r in lines.collect()}
    if not blanks:
        lines = lines.where("line <> ''").withColumn("gap", F.lit(False))
    rows = chat.decode(lines, chat.learn(turns)).collect()
    truth = {(r.conv_id, r.turn): r.role for r in turns.collect()}
    right = sum(chat.ROLES[r.state // 2] == truth[r.conv_id, turn_of[r.conv_id, r.pos]] for r in rows) / len(rows)
    assert right > (0.95 if blanks else 0.8) and len(rows) == lines.count()


def brute_turns(lines, model):
    """Viterbi over each whole transcript, then turns from one open state to the next."""
    held, out = collections.defaultdict(list), []
    for r in lines:
        held[r["conv_id"]].append(r)
    for conv, rows in held.items():
        rows.sort(key=lambda r: r["pos"])
        path = chat.through([model.step(r) for r in rows], chat.START, None)
        opens = [i for i, s in enumerate(path) if s % 2 == 0]
        for i, j in zip(opens, [*opens[1:], len(rows)]):
            role, text = chat.ROLES[path[i] // 2], [r["line"] for r in rows[i:j]]
            head = chat.marker_of(text[0])[1]
            body = ([head] if head or len(text) == 1 else []) + text[1:]
            while body and not body[-1].strip():
                body.pop()
            out.append((conv, rows[i]["pos"], role, j - i, "\n".join([f"<|{role}|>", *body, "<|end|>"])))
    return sorted(out, key=str)


@pytest.mark.parametrize("size,fan", [(256, 64), (7, 3)])
def test_chat_turns_against_brute_force(spark, monkeypatch, size, fan):
    """Blocks change nothing, whatever turns are numbered like and however long they are."""
    monkeypatch.setattr(chat, "LINES", size)
    monkeypatch.setattr(chat, "FAN", fan)
    rows = [(7, i, ("user", "assistant")[i % 2], f"line {i}?" if i % 2 == 0 else f"answer {i}\n- more") for i in range(100)]
    rows += [(8, 0, "user", ""), (9, -5, "user", "early"), (9, 10**12, "assistant", "late"), (9, 10**12, "assistant", "late"), (10, 0, "user", "a"), (10, None, "user", "b"), (10, None, "assistant", "c"), (None, 0, None, None), (11, 3, "system", "x\n" * 400), (11, 4, "user", "y")]
    turns = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, pos long, line string")
    lines, model = chat.transcripts(turns), chat.learn(turns)
    collected = [r.asDict() for r in lines.collect()]
    for conv in {r["conv_id"] for r in collected}:
        assert sorted(r["pos"] for r in collected if r["conv_id"] == conv) == list(range(sum(r["conv_id"] == conv for r in collected)))
    first = sorted((r for r in collected if r["conv_id"] == 10), key=lambda r: r["pos"])
    assert first[-1]["turn"] == 0 and [r["turn"] for r in first[:4]] == [None] * 4  # rows without a number come first, each on lines of its own
    got = sorted((tuple(r) for r in chat.parse(lines, model).collect()), key=str)
    assert got == brute_turns(collected, model)
    assert chat.parse(chat.transcripts(turns.limit(0)), model).count() == 0


def test_chat_of_the_driver_against_brute_force(spark):
    turns = source(spark, DATA, "conversations")
    got = sorted((tuple(r) for r in queries.op3_chat(spark, DATA).collect()), key=str)
    assert got == brute_turns([r.asDict() for r in chat.transcripts(turns).collect()], chat.learn(turns))


def test_packing_round_trip(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = source(spark, DATA, "documents").select("doc_id", "text").union(spark.createDataFrame([(-1, "a <|endoftext|> b"), (-2, "<|endoftext|>" * 600)], "doc_id long, text string"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = packing.pack(docs, queries.tokenizer_path()).collect()
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in text.items()}
    assert ids[-1] == [64, 220, 50256, 275, 0]
    covered, fill = {d: [0] * len(x) for d, x in ids.items()}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id][r.start : r.start + r.length] = [1 + c for c in covered[r.doc_id][r.start : r.start + r.length]]
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(set(c) == {1} for c in covered.values()) and sorted(fill) == list(range(len(fill)))
    pad = 0
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
        pad += packing.padded(at) - at
    assert pad < 0.02 * sum(map(len, ids.values()))


def test_pieces_of_a_length_in_many_places(spark, monkeypatch):
    """However many places rank a length's pieces, sequences are filled without gaps."""
    monkeypatch.setattr(packing, "RANKED", 3)
    docs = spark.createDataFrame([(None if i % 3 else i % 7, "word " * (i % 5 * 300)) for i in range(120)], "doc_id long, text string")
    fill: dict = {}
    for r in packing.pack(docs, queries.tokenizer_path()).collect():
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(fill) == list(range(len(fill)))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=60) | st.lists(st.sampled_from(["'s", " ", "  ", "\n", "\t", "1", "23", "½", "²", "a", "É", "ß", "_", "-", "...", "\u00a0", "\u0085", "\x1c", "ab", "<|", "|>", "I'LL"]), max_size=30).map("".join))
def test_fast_ids_are_the_tokenizers(text):
    assert ENCODER.encode(text) == np.array(PLAIN.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_edge_cases(spark, odd, none):
    got = packing.pack(odd, queries.tokenizer_path()).collect()
    assert sum(r.length for r in got if r.doc_id in (1, 2)) == 2 and sum(r.doc_id == 5 for r in got) == 2
    assert packing.pack(none, queries.tokenizer_path()).count() == 0
    e = packing.Encoder(queries.tokenizer_path())
    for t in ("", "I'll go\n\n to  3½²  x\x1c", "日本 é", "<|endoftext|>", "a" * 3000, " \u0085 x "):
        assert e.encode(t) == e.whole(t)


def test_plans_fill(spark):
    rng = np.random.RandomState(0)
    for n in (1, 7, 300, 5000):
        lengths, counts = np.unique(rng.randint(1, 1025, n), return_counts=True)
        p = packing.plan(dict(zip(lengths.tolist(), counts.tolist())))
        fills = np.zeros(int(p.counts.sum()), np.int64)
        for length, c in zip(lengths, counts):
            _, _, size, sequence, _ = packing.place_all(p, np.full(c, length), np.arange(c))
            np.add.at(fills, sequence, size)
        assert fills.sum() == (lengths * counts).sum() and fills.max() <= 1024 and fills.min() > 0
