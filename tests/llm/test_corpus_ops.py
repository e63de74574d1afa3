"""Deduplication, joins, mixing, archives and the pipeline against brute force."""

import collections
import gzip
import io
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import _shared, exact_dedup, itq_dedup, mixing, ngram_join, queries, warc
from folioscan.llm._shared import source

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, keep_id long"
ODD = [
    (1, None, "en", None, 0, 1, 1), (2, "", "en", "a", 0, 1, 1), (None, "one two three four five", "en", "a", 0, 1, 1), (4, "word " * 50_000, None, "a", 0, None, None),
    (5, "Same Text here now", "en", "b", 0, 1, 1), (5, "Same Text here now", "en", "b", 0, 1, 1), (6, "same text HERE now", "en", "b", 0, 1, 1), (7, "É text", "en", "b", 0, 1, 1), (8, "é text", "en", "b", 0, 1, 1), (9, "x", "en", "b", 0, 1, 1),
]


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture()
def shuffled(monkeypatch):
    """No list is small enough to broadcast, no graph for one task."""
    for m in (_shared,):
        monkeypatch.setattr(m, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(m, "EDGES", -1)


def components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_exact_edge_cases(spark, odd, none):
    got = sorted(((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.find_copies(odd).collect()))
    assert got == [("1", 2, 2, False), ("2", 2, 2, True), ("4", 4, 1, True), ("5", 6, 3, False), ("5", 6, 3, False), ("6", 6, 3, True), ("7", 7, 1, True), ("8", 8, 1, True), ("9", 9, 1, True), ("None", None, 1, True)]
    assert exact_dedup.find_copies(none).count() == 0
    kept = exact_dedup.drop_copies(odd.union(odd.where("doc_id = 9")))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "6", "7", "8", "9", "None"] and kept.columns == odd.columns


def test_exact_by_shuffling(spark, shuffled):
    docs = source(spark, DATA, "documents")
    got = {r.doc_id: r.keep_id for r in exact_dedup.find_copies(docs).collect()}
    last: dict = {}
    for r in docs.collect():
        key = r.text.encode().lower()
        last[key] = max(last.get(key, -1), r.doc_id)
    assert got == {r.doc_id: last[r.text.encode().lower()] for r in docs.collect()}


@pytest.mark.parametrize("range_bits", [0, 3, 8])
def test_filters_merge_without_loss(range_bits):
    rng = np.random.RandomState(1)
    keys = np.concatenate([rng.randint(0, 2**63, 500, dtype=np.int64).astype(np.uint64) * np.uint64(2), np.array([0, 1, 2, 2**64 - 1, 2**64 - 2], np.uint64), np.arange(300, dtype=np.uint64) + np.uint64(7 << 60)])
    drawn = [rng.choice(keys, 600) for _ in range(5)] + [keys[:0], keys[:1]]
    parts = collections.defaultdict(list)
    for d in drawn:
        for q, f in exact_dedup.by_range(*exact_dedup.once(d, np.ones(len(d), np.int64)), range_bits):
            parts[q].append(exact_dedup.CountingQuotientFilter.load(f.dump()))
    got = collections.Counter()
    for q, filters in parts.items():
        f = exact_dedup.CountingQuotientFilter.merged(64 - range_bits, filters)
        k, n = f.items()
        assert (k[1:] > k[:-1]).all() and len(f.remainders) >= len(k)
        got.update({int(x) | q << (64 - range_bits): int(c) for x, c in zip(k, n)})
    assert got == collections.Counter(int(x) for d in drawn for x in d)
    assert len(exact_dedup.CountingQuotientFilter().items()[0]) == 0


def test_filters_are_small():
    """A full filter has less than a fingerprint's eight bytes and its share of the free slots."""
    keys = np.unique(np.random.RandomState(2).randint(0, 2**63, 98_000, dtype=np.int64).astype(np.uint64))
    assert len(exact_dedup.CountingQuotientFilter(64, keys, np.ones(len(keys), np.int64)).dump()) < 8.7 * len(keys)


def near_brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    comp = components(sets, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_near_groups_on_chains(spark, k, num):
    """Groups whose members drift apart, with some pairs just over and some just under the limit."""
    rng, rows = random.Random(k), []
    words = ["w%d" % i for i in range(400)]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice((8, 30, 120)))]
        for _ in range(12):
            rows.append((len(rows), " ".join(base)))
            for _ in range(rng.choice((0, 1, 1, 2))):
                base[rng.randrange(len(base))] = rng.choice(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(docs, k, num, 100).collect()} == near_brute(rows, k, num, 100)


def test_near_groups_over_many_blocks(spark, monkeypatch):
    """A cluster of near copies that is cut into many blocks, some of its sets far from its hub."""
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    monkeypatch.setattr(ngram_join, "COLUMNS", 16)
    rng, words = random.Random(11), ["w%d" % i for i in range(300)]
    base, rows = [rng.choice(words) for _ in range(150)], []
    for i in range(60):
        t = list(base)
        for _ in range(rng.choice((1, 2, 3, 5, 8))):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(docs, 5, 80, 100).collect()} == near_brute(rows, 5, 80, 100)


@pytest.mark.parametrize("num,den", [(80, 100), (90, 100), (3, 5)])
def test_prefix_bounds(num, den):
    """Linked sets share what the filters ask for, under any order of their tokens."""
    rng = random.Random(num)
    for _ in range(400):
        n, m = rng.randint(ngram_join.least_set(num, den), 90), 0
        while not num * max(n, m) <= den * min(n, m):
            m = rng.randint(1, 120)
        overlap = -(-num * (n + m) // (num + den))
        if overlap > min(n, m):
            continue
        order = list(range(n + m - overlap))
        rng.shuffle(order)
        worst = rng.random() < 0.5  # what only one set has comes first
        ids = order if not worst else sorted(order, key=lambda t: t < overlap)
        a, b = ([t for t in ids if t < overlap or t - overlap < n - overlap], [t for t in ids if t < overlap or t - overlap >= n - overlap])
        assert len(a) == n and len(b) == m and den * overlap >= num * (n + m - overlap)
        p, q = ngram_join.prefix_length(n, num, den), ngram_join.prefix_length(m, num, den)
        shared = set(a[:p]) & set(b[:q])
        assert len(shared) >= min(p - n, q - m) + overlap >= (-(-num * n // den) * (den - num)) // (ngram_join.EXTRA * den) + 1
        assert p <= n and min(map(a.index, shared)) <= n - overlap and min(map(b.index, shared)) <= m - overlap


def test_near_edge_cases(spark, odd, none, shuffled):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.near_groups(odd, 3, 90, 100).collect())
    assert got == [("1", 0, 1), ("2", 0, 2), ("4", 1, 4), ("5", 2, 5), ("5", 2, 5), ("6", 2, 5), ("7", 1, 7), ("8", 1, 8), ("9", 1, 9), ("None", 3, None)]
    assert ngram_join.near_groups(none).count() == 0
    assert ngram_join.drop_near_copies(odd).columns == odd.columns


def test_near_groups_in_parts(spark, monkeypatch):
    """However few tokens may be on disk at once, the links stay; no part has the tokens of all sets."""
    rng, rows = random.Random(8), []
    for g in range(6):
        base = [f"w{g}_{i}" for i in range(60)]
        for _ in range(4):
            rows.append((len(rows), " ".join(base)))
            base[rng.randrange(60)] = f"v{len(rows)}"
    held, write = [], ngram_join.table

    def noted(df, name):
        out = write(df, name)
        if name == "sets" and "tokens" in out.columns:
            held.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "table", noted)
    monkeypatch.setattr(ngram_join, "HELD_BYTES", 6000, raising=False)
    monkeypatch.setattr(ngram_join, "HELD_SHARE", 1 << 30, raising=False)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()}
    assert got == near_brute(rows, 5, 80, 100) and max(held) < len(rows)


def test_tables_leave_no_shuffle_files(spark):
    def files():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}

    before = files()
    got = _shared.table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().join(spark.range(7).withColumnRenamed("id", "k").hint("merge"), "k"), "counted")
    assert not files() - before and got.count() == 7
    assert spark.conf.get(_shared.TIDY, None) != "true"
    spark.range(10).repartition(3).collect()
    assert files() - before


def test_linked_parts():
    rng = np.random.RandomState(2)
    sets = [np.unique(rng.randint(0, 60, 40)).astype(np.uint64) for _ in range(40)]
    part = ngram_join.linked_parts(sets, 60, 100)
    s = [set(x.tolist()) for x in sets]
    want = components(range(40), [(a, b) for a, b in itertools.combinations(range(40), 2) if 100 * len(s[a] & s[b]) >= 60 * len(s[a] | s[b])])
    assert part == [want[i] for i in range(40)]


@pytest.mark.parametrize("at_once", [0, 10**6])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(_shared, "EDGES", at_once)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    got = {r.id: r.component for r in _shared.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    ids = {x for e in edges for x in e if e[0] != e[1]}
    assert got == components(ids, [e for e in edges if e[0] != e[1]])


def test_vectors(spark):
    rng = np.random.RandomState(3)
    base = rng.randn(60, 16)
    rows = []
    for i in range(240):
        v = base[i % 60] + rng.randn(16) * 0.06 * (i // 60)
        rows.append((i, [float(x) for x in v], i % 60 % 3))
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [None] * 16, 1), (305, rows[0][1], None), (306, [x * 2 for x in rows[0][1]], 0), (307, rows[0][1], 0), (307, rows[0][1], 0), (None, rows[1][1], 1), (308, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = itq_dedup.link_vectors(df).collect()
    assert len(got) == len(rows)
    ok = [(i, np.array(v), g) for i, v, g in rows if v and g is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = sum(len(a[1]) == len(b[1]) and a[2] == b[2] and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93 for a, b in itertools.combinations(ok, 2))
    assert 0.9 * links <= sum(r.n_links for r in got) / 2 <= links
    by = {r.vec_id: r for r in got}
    assert by[300].n_links == 0 and by[300].component_id == 300 and by[305].n_links == 0 and by[307].component_id == 0 and by[307].n_links >= 4
    assert itq_dedup.link_vectors(df.limit(0)).count() == 0


def test_labels_stay_apart(spark):
    """Equal vectors link only if their labels are equal, whatever the labels' hashes."""
    v = [0.5, -1.0, 2.0, 0.25]
    labels = [-1, -2, 5, 5 + 2**32, 7, 7]
    df = spark.createDataFrame([(i, v, g) for i, g in enumerate(labels)], "vec_id long, embedding array<double>, label long")
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq_dedup.link_vectors(df).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4)}


def test_planted_links(spark):
    """Pairs planted at the limit among the driver's vectors, which hold no link of their own, against brute force."""
    rng = np.random.RandomState(9)
    rows = [(r.vec_id, np.array(r.embedding, float), r.label) for r in source(spark, DATA, "embeddings").collect()]
    for i in range(200):
        _, u, g = rows[i]
        z = rng.randn(len(u))
        z -= z @ u / (u @ u) * u
        c = rng.choice([0.925, 0.935, 0.95, 0.99])
        rows.append((10_000 + i, c * u / np.linalg.norm(u) + np.sqrt(1 - c * c) * z / np.linalg.norm(z), g))
    df = spark.createDataFrame([(i, [float(x) for x in v], g) for i, v, g in rows], "vec_id long, embedding array<double>, label int")
    x, label = np.array([v / np.linalg.norm(v) for _, v, _ in rows]), np.array([g for _, _, g in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    links = near.sum() - len(rows)
    got = itq_dedup.link_vectors(df).collect()
    assert links > 200 and 0.97 * links <= sum(r.n_links for r in got) <= links


def test_recall(spark):
    e = source(spark, DATA, "embeddings").collect()
    v = np.array([r.embedding for r in e])
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r.label for r in e])
    near = (v @ v.T >= 0.93) & (label[:, None] == label[None])
    got = queries.op7_embedding_dedup(spark, DATA).agg(F.sum("n_links")).first()[0]
    assert got >= 0.9 * (near.sum() - len(v))


def test_mix(spark, odd, none):
    rows = mixing.mix(source(spark, DATA, "documents")).collect()
    by = collections.defaultdict(lambda: [0, 0, 0])
    for r in rows:
        assert r.taken <= 2 * r.size
        by[r.source][0] += r.size
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
    assert abs(sum(b[2] for b in by.values()) - 1.5 * sum(b[0] for b in by.values())) < 1
    assert all(b[2] <= 2 * b[0] + 1e-6 for b in by.values())
    assert max(abs(b[1] - b[2]) / b[2] for b in by.values()) < 0.1
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and {r.size for r in got if r.source is None} == {0} and mixing.mix(none).count() == 0
    out = mixing.apply_mix(odd)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in got)


def fill(sizes, weights, share, most):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, rest = dict.fromkeys(order, 0.0), share * sum(sizes.values())
    open_ = set(order)
    while open_ and rest > 1e-6:
        total, left = sum(weight[s] for s in open_), 0.0
        for s in open_:
            target[s] += rest * weight[s] / total
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
        open_, rest = {s for s in open_ if target[s] < most * sizes[s]}, left
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice((0, 1, 7, 100, 5000, 10**6)) for s in [None, "", "é", "Z", *(f"s{i}" for i in range(rng.choice((0, 3, 60))))]}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = fill(sizes, mixing.WEIGHTS, 1.5, 2.0)
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-6, abs=1e-3) for s in got)


@pytest.mark.parametrize("places", [3, 100_000])
def test_words_come_near_targets(spark, monkeypatch, places):
    """Within two of the largest documents mixed by rate, a fiftieth of the source, whatever the sizes and the places."""
    monkeypatch.setattr(mixing, "RANKED", places)
    rng, rows = random.Random(places), []
    for s in ("a", "b", "c", None):
        for _ in range(400):
            rows.append((len(rows), "w " * int(rng.lognormvariate(2.5, 1.2)), s))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, again = mixing.mix(df).collect(), mixing.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    for s in ("a", "b", "c", None):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= own[0].source_size / 50
        assert all(r.copies in (0, 1, 2) for r in own)


def test_targets_reshare(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(s).collect()}
    assert got["a"] == 20 and abs(sum(got.values()) - 1.5 * 2510) < 1e-6 and got["b"] == pytest.approx(2 * got["c"])


def page_rows():
    big, small = "<p>" + "x" * 1200 + "é</p>", "tiny"
    return [(1, "http://a", big), (2, None, big), (3, "u", small), (4, "u", small), (5, "u\r\nX: y", None), (None, "n", "z" * 1500), (6, "w", "Content-Length: 5\r\n\r\n" * 99), (7, "d", "q" * 1001), (7, "d", "q" * 1001)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*r, 9) for r in page_rows()], "page_id long, url string, html string, digest long")
    records, archives = warc.archive_pages(pages)
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in records.collect())
    assert got == [("1", 1209, "revisit", 2), ("2", 1209, "response", None), ("3", 4, "response", None), ("4", 4, "response", None), ("5", 0, "response", None), ("6", 99 * 21, "response", None), ("7", 1001, "response", None), ("7", 1001, "response", None), ("None", 1500, "response", None)]
    for a in archives.collect():  # each member opens by itself at its offset
        raw = open(a.path.removeprefix("file://"), "rb").read()
        for e in map(json.loads, open(a["index"].removeprefix("file://"))):
            one = gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]])
            assert one.startswith(b"WARC/1.1\r\nWARC-Type: " + e["type"].encode()) and warc.take_record(one) == len(one)
    assert warc.archive_pages(pages.limit(0))[0].count() == 0


def test_normaliser_takes_any_members():
    records = [warc.record(i, "u", b"x" * n, "d", None, False) for i, n in enumerate((0, 5, 3_000_000))]
    whole = gzip.compress(b"".join(records))
    mixed = gzip.compress(records[0][:20]) + gzip.compress(records[0][20:] + records[1]) + gzip.compress(records[2])
    for data in (whole, mixed):
        f = io.BytesIO(data)
        assert list(warc.inflate(iter(lambda: f.read(1000), b""))) == records
    with pytest.raises(ValueError):
        list(warc.inflate(iter([gzip.compress(records[1][:-10])])))


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from folioscan.llm import packing, toxicity

    docs = source(spark, DATA, "documents")
    rows = docs.collect()
    model = toxicity.learn(docs, source(spark, DATA, "labels"))
    a = model.automaton()
    fine = [r for r in rows if toxicity.score(model.curve, np.array([toxicity.features(h := toxicity.hits(a, s := toxicity.fold(r.text or "")), len(s.split()) if h else 1)]))[0] < 0.5]
    last: dict = {}
    for r in fine:
        last[(r.text or "").encode().lower()] = max(r.doc_id, last.get((r.text or "").encode().lower(), -1))
    once = [r for r in fine if last[(r.text or "").encode().lower()] == r.doc_id]
    near = near_brute([(r.doc_id, r.text) for r in once], 5, 80, 100)
    lone = [r for r in once if near[r.doc_id][1] == r.doc_id]
    size: dict = collections.defaultdict(int)
    for r in lone:
        size[r.source] += len((r.text or "").encode().split())
    got = corpus_pipeline.run(spark, DATA).collect()
    encoder = packing.Encoder(queries.tokenizer_path())
    tokens = {r.doc_id: len(encoder.encode(r.text or "")) // 4 + 1 for r in lone}
    copies = collections.Counter()
    for r in got:
        assert r.doc_tokens == tokens[r.doc_id]  # nothing that a stage dropped comes back
        copies[r.doc_id] += r.length
    assert all(n % tokens[d] == 0 and n // tokens[d] in (1, 2) for d, n in copies.items())
    words = {r.doc_id: len((r.text or "").encode().split()) for r in lone}
    taken = sum(words[d] * n // tokens[d] for d, n in copies.items())
    assert abs(taken - 1.5 * sum(size.values())) < 0.03 * sum(size.values())


def test_pipeline_edge_cases(spark, tmp_path):
    """Null, empty, repeated rows and clashing columns go through all stages; so does an empty table."""
    import corpus_pipeline

    clash = "node long, row long, component string, token string, n long, rank int, taken long, copies int, l_id long, _fs_id long, score double"
    base = [(1, None, "en", None, 0), (2, "", "en", "a", 0), (None, "one two three four five six", "en", "a", 0), (4, "word " * 30_000, None, "a", 0), (5, "Same Text here now", "en", "b", 0), (5, "Same Text here now", "en", "b", 0), (6, "same text HERE now", "en", "b", 0), (9, "x", "en", "b", 0), (9, "y z", "en", "b", 0)]
    odd = spark.createDataFrame([(*r, *range(9, 11), "c", "t", 1, 2, 3, 4, 5, 6, 0.5) for r in base], f"doc_id long, text string, lang string, source string, n_chars long, {clash}")
    spark.createDataFrame([(1, 0), (None, 1), (5, None)], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/some/labels.parquet")
    for docs, rows in ((odd, 7), (odd.limit(0), 0)):
        for i, (name, step) in enumerate(corpus_pipeline.STAGES):
            step(spark, docs, f"file://{tmp_path}/some").write.parquet(f"file://{tmp_path}/{rows}/{i}")
            docs = spark.read.parquet(f"file://{tmp_path}/{rows}/{i}")
            if i < 4:
                assert docs.columns == odd.columns, name
            if name == "exact dedup":
                assert sorted(str(r.doc_id) for r in docs.collect()) == (["2", "4", "6", "9", "9", "None"] if rows else [])
        assert bool(docs.count()) == bool(rows) and not [p for p in _shared.written if p in corpus_pipeline._spent[:0]]


def test_stages_delete_spent_tables(spark):
    import corpus_pipeline

    before = {*_shared.written}
    corpus_pipeline.run(spark, DATA).count()
    assert {*_shared.written} <= before
