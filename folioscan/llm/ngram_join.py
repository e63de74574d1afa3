"""Exact Jaccard self-join on word shingles by prefix filters under several global token orders.

Two sets with Jaccard >= num/den share tokens in their prefixes under *any* global order of the tokens, so candidates are
asked to pass under each of several orders: shingles of rare words first, and the hash values upwards and downwards. A
prefix is longer than one shared token needs (by EXTRA of the tokens that may differ), so that linked sets share a known
number of tokens in it. Word frequencies are counted over all documents; words below a fixed rate count as equally rare,
so the list of frequent words stays bounded however many documents there are.

The first order's filter works before any pair exists: a prefix token that only one set has is dropped, and a set that is
left with fewer tokens than any link needs is out. Sets that share at least half their prefix with the first holder of its
tokens (the hub), under the first order or among the lowest hash values, form clusters of near copies; any clustering would
do. Between clusters, pairs must
share a token early enough in both prefixes, with enough shared tokens on either side; then all orders are intersected.
What passes joins its clusters. Within a cluster, sets are compared by matrix products in blocks: each block with itself
and the cluster's hub first, then what did not join the cluster's largest part with all blocks. Parts are put out as stars,
not pairs. No link between different sets is lost.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Batches, as_long, batches, by_rows, connected_components, ddl, emit, free, only, parts_for, row_key, sized, table, texts, trim

U = np.uint64
#: Odd multipliers, one for each word of a shingle and then for each hash of a band or an order.
ODD = np.random.RandomState(20240501).randint(0, 2**63 - 1, 64, dtype=np.int64).astype(U) * U(2) + U(1)
#: A word in fewer than this share of the documents counts as rare.
RARE = 0.0002
#: A prefix has so many more tokens than one shared token needs: 1 / EXTRA of those that may differ.
EXTRA = 4
#: Sets, and tokens, of a cluster that are held in one block; columns of a matrix that are held at once.
BLOCK, BLOCK_TOKENS, COLUMNS = 1000, 1_000_000, 4096
#: Bytes of tokens that are on disk at once while clusters are compared, or this share of the tokens of all sets if that is more.
HELD_BYTES, HELD_SHARE = 1 << 30, 8
#: Lowest tokens of a set by which hubs are found; half of them shared with a hub make a near copy.
LOWEST = 8
#: Rounds of growing clusters, and of dropping sets with too few shared prefix tokens.
ROUNDS = 2


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def listed(rows: list, kind: pa.DataType) -> pa.Array:
    """A list column from arrays, in one piece."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    flat = np.concatenate([np.asarray(x, kind.value_type.to_pandas_dtype()) for x in rows])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind.value_type)).cast(kind)


class WordHashes(dict):
    """64-bit hashes of words; forgets all when full, which changes no hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # bytes: lower-cases A-Z, splits at space and \x09-\x0D
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def shingles(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, and where each first starts. Fewer than k words are one shingle."""
    if len(h) == 0:
        return h, np.zeros(0, np.int64)
    w = min(k, len(h))
    m = len(h) - w + 1
    s = np.full(m, U(w))
    for j in range(w):
        s += h[j : j + m] * ODD[j]
    return np.unique(mix(s), return_index=True)


def least_set(num: int, den: int) -> int:
    """Sets of fewer tokens are at or over the limit only with an equal set."""
    return -(-num // (den - num))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 + n * (den - num) // (EXTRA * den)


def prefix_of(n: str, num: int, den: int) -> Column:
    """prefix_length() of a column."""
    return F.expr(f"{n} - (({num}L * {n} + {den - 1}) div {den}) + 1 + ({n} * {den - num}L div {EXTRA * den})")


def overlap_of(n: str, m: str, num: int, den: int) -> Column:
    """Tokens that linked sets of n and m tokens share at least."""
    return F.expr(f"({num}L * ({n} + {m}) + {num + den - 1}) div {num + den}")


def common_words(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, log2 of the share of documents in units of RARE) of words in at least RARE of all documents.

    At most the mean number of distinct words of a document / RARE words, however many documents. Blocks leave out words
    that are rare within them, so counts err low; the order of tokens is only a matter of speed, never of results.
    """
    out = batches({"word": pa.int64(), "n": pa.int64()})

    def count(it: Batches) -> Batches:
        held, rows = Counter(), 0

        def flush():
            least = max(2, int(rows * RARE / 2))
            some = [(xxhash.xxh3_64_intdigest(w), n) for w, n in held.items() if n >= least]
            return emit(out, as_long(np.array([h for h, _ in some], U)), [n for _, n in some])

        for b in it:
            for x in texts(b):
                held.update(set(x.lower().split()))
                rows += 1
                if len(held) >= 200_000:
                    yield flush()
                    held, rows = Counter(), 0
        if rows:
            yield flush()
        trim()

    found = docs.select("text").mapInArrow(count, ddl(out)).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, total * RARE / 2)).toArrow()
    words, n = (np.concatenate([np.zeros(0, np.int64), *(c.to_numpy() for c in found.column(i).chunks)]) for i in (0, 1))
    order = np.argsort(words.view(U))
    return words.view(U)[order], np.log2(2 + n[order] / max(1, total * RARE))


def signatures(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], k: int, num: int, den: int) -> DataFrame:
    """One row per document: doc_id, row_key, row (its number), n, node (hash of the whole set, its class), rare: the prefix of rare tokens, low: the LOWEST first ones upwards; both empty for sets that only link with equal ones."""
    out = batches({"doc_id": pa.int64(), "row_key": pa.int64(), "n": pa.int32(), "node": pa.int64(), "rare": pa.list_(pa.int64()), "low": pa.list_(pa.int64())})
    least, words, weights = least_set(num, den), *common

    def run(it: Batches) -> Batches:
        cache = WordHashes()
        for b in it:
            rows = []
            for x in texts(b):
                h = cache.of(x)
                s, first = shingles(h, k)
                n = len(s)
                row = [n, as_long(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], U))[0] if n else None, [], []]
                if n >= least:
                    w = np.zeros(len(h))
                    if len(words):
                        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                        w = np.where(words[at] == h, weights[at], 0)
                    c = np.concatenate([[0], np.cumsum(w)])
                    width = min(k, len(h))
                    # Rare first; the sort is stable, so ties go by hash.
                    order = np.argsort(np.round((c[width:] - c[:-width])[first] * 100).astype(np.int32), kind="stable")
                    row[2:] = as_long(s[order[: prefix_length(n, num, den)]]), as_long(s[:LOWEST])
                rows.append(row)
            if rows:
                n, node, *lists = map(list, zip(*rows))
                yield emit(out, b.column("doc_id"), b.column("row_key"), n, node, *(listed(x, out.field(i + 4).type) for i, x in enumerate(lists)))
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("row_key")).mapInArrow(run, ddl(out)).withColumn("row", F.monotonically_increasing_id())


def sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, k: int, ends: tuple[int, int] | None = None) -> DataFrame:
    """(node, n, tokens) of the wanted classes, from the whole text of one row of each. tokens: the set's, in order, as bytes; with ends (num, den), only its prefix upwards, then that downwards."""
    wanted = table(only(classes.select("node", "row_key"), nodes, "node").select("row_key"), "wanted")
    out = batches({"node": pa.int64(), "n": pa.int32(), "tokens": pa.binary()})

    def cut(s: bytes) -> bytes:
        size = 8 * prefix_length(len(s) // 8, *ends)
        return s[:size] + s[len(s) - size :]

    def run(it: Batches) -> Batches:
        cache = WordHashes()
        for b in it:
            sets = [shingles(cache.of(x), k)[0].tobytes() for x in texts(b)]
            if sets:
                yield emit(out, as_long(np.fromiter(map(xxhash.xxh3_64_intdigest, sets), U, len(sets))), [len(s) // 8 for s in sets], [cut(s) for s in sets] if ends else sets)
        trim()

    some = only(docs.select("text", row_key().alias("row_key")), wanted, "row_key").select("text")
    found = only(some.mapInArrow(run, ddl(out)), nodes, "node").groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    found = table(found, "sets")
    free(wanted)
    return found


def linked_parts(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """For each set, the first set of its part; parts are connected by pairs with Jaccard >= num/den."""
    n = np.array([len(s) for s in sets])
    tokens, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    again = count > 1  # what only one set has is in no intersection
    at = np.where(again, np.cumsum(again) - 1, -1)[column]
    row, width = np.repeat(np.arange(len(sets)), n)[at >= 0], int(again.sum())
    at = at[at >= 0]
    by = np.argsort(at, kind="stable")
    row, at = row[by], at[by]
    same = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, width, COLUMNS):  # a stretch of tokens at a time
        i, j = np.searchsorted(at, (c, c + COLUMNS))
        x = np.zeros((len(sets), min(COLUMNS, width - c)), np.float32)
        x[row[i:j], at[i:j] - c] = 1
        same += x @ x.T
    same = same.astype(np.int64)
    near = den * same >= num * (n[:, None] + n[None] - same)
    part = np.full(len(sets), -1)
    for i in range(len(sets)):
        if part[i] < 0:
            new = np.zeros(len(sets), bool)
            new[i] = True
            while new.any():
                part[new] = i
                new = near[new].any(0) & (part < 0)
    return part.tolist()


def links_of(sent: DataFrame, num: int, den: int) -> DataFrame:
    """(place, i, j, component, node, tokens) -> links (u, v) that connect, in each group by place, i and j, what pairs of a component connect."""
    links = batches({"u": pa.int64(), "v": pa.int64()})

    def meet(group):
        node, held = group.column("node").to_pylist(), [np.frombuffer(t, U) for t in group.column("tokens").to_pylist()]
        cluster = group.column("component").to_numpy()
        out = []
        for c in np.unique(cluster):
            at = np.flatnonzero(cluster == c)
            if len(at) > 1:
                out += [(node[at[i]], node[at[p]]) for i, p in enumerate(linked_parts([held[i] for i in at], num, den)) if i != p]
        if len(node) > BLOCK // 2:
            trim()
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], []))], schema=links)

    return sent.groupBy("place", "i", "j").applyInArrow(meet, ddl(links))


def links_sent(docs: DataFrame, classes: DataFrame, sent: DataFrame, k: int, num: int, den: int, held: int) -> DataFrame:
    """links_of() of sent(node, n, component, place, i, j), a table, with the tokens of its sets.

    Tokens are the bulk of what is written, so groups are dealt to as many parts as keep the tokens sent in a part to about
    held bytes, and the list of its sets short enough to broadcast. Parts come one after the other; each makes its sets from
    the texts anew, so no token is on disk but those of one part.
    """
    size, nodes = sent.agg(F.sum(F.col("n").cast("long") * 8), F.count_distinct("node")).first()
    parts, many = max(1, -(-(size or 0) // held)), parts_for(nodes)
    part = F.pmod(F.xxhash64("component", "i"), F.lit(max(parts, many)))
    if parts == many == 1:
        part = F.lit(0)
    elif not sent.where("i <> j").isEmpty():  # by both sides, else a part has all sets of a side
        side = max(int(np.ceil(np.sqrt(parts))), 2 * many if many > 1 else 1)
        part = F.pmod(F.xxhash64("component", "i"), F.lit(side)) * side + F.pmod(F.xxhash64("component", "j", F.lit(1)), F.lit(side))
    sent = sent.withColumn("part", part)
    links = None
    for p in [r.part for r in sent.select("part").distinct().sort("part").collect()]:
        some = table(sent.where(F.col("part") == p), "part")
        wanted = table(some.select("node").distinct(), "nodes")
        sets = sets_of(docs, classes, wanted, k)
        found = table(links_of(sets.select("node", "tokens").join(sized(some), "node").select("place", "i", "j", "component", "node", "tokens"), num, den), "links")
        free(some, wanted, sets)
        links = found if links is None else links.union(found)
    return docs.sparkSession.createDataFrame([], "u long, v long") if links is None else links


def links_within(docs: DataFrame, classes: DataFrame, clusters: DataFrame, k: int, num: int, den: int, held: int) -> DataFrame:
    """(id, component) of clusters, (node, n, row_key) of classes -> links (u, v) that connect what pairs within a cluster connect.

    A cluster is cut into blocks of about BLOCK sets or BLOCK_TOKENS tokens. Each block is compared with itself and with
    the set its cluster is named after; small clusters share places. Of a cluster with more blocks, sets that are not
    linked, by then, with its largest part are compared with every block. held: see links_sent().
    """
    own = table(clusters.withColumnRenamed("id", "node").join(classes.select("node", "n"), "node"), "own")
    size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int")
    blocks = table(own.groupBy("component").agg(size.alias("blocks"), F.sum("n").alias("tokens")), "blocks")
    places = max(1, (blocks.agg(F.sum("tokens")).first()[0] or 0) // (BLOCK_TOKENS // 4))
    of = own.join(sized(blocks), "component").select("node", "n", "component", "blocks", F.pmod(F.xxhash64("component"), F.lit(places)).alias("place"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    of = table(of, "blocked")
    free(own, blocks)
    hubs = of.where("node = component and blocks > 1").select("node", "n", "component", "place", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"), "block").where("to <> block")
    first = table(of.select("node", "n", "component", "place", F.col("block").alias("i")).union(hubs.select("node", "n", "component", "place", "to")).withColumn("j", F.col("i")), "sent")
    links = links_sent(docs, classes, first, k, num, den, held)
    free(first)
    many = table(of.where("blocks > 1"), "many")
    if many.isEmpty():
        return links
    parts = sized(connected_components(links).select(F.col("id").alias("node"), F.col("component").alias("part")))
    many = table(many.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "parted")
    main = many.groupBy("component", "part").agg(F.count("*").alias("c")).groupBy("component").agg(F.max_by("part", F.struct("c", "part")).alias("main"))
    many = table(many.join(sized(table(main, "main")), "component").withColumn("open", F.col("part") != F.col("main")), "open")
    left = table(many.where("open").groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("groups")), "groups")
    many = many.join(sized(left), "component")
    # Open sets go to all blocks, in groups; all others go to all groups.
    every, group = F.sequence(F.lit(0), F.col("blocks") - 1), F.pmod(F.xxhash64("node", F.lit(1)), F.col("groups")).cast("int")
    out = many.where("open").select("node", "n", "component", group.alias("i"), F.explode(every).alias("j"))
    back = many.select("node", "n", "component", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("i"), F.col("block").alias("j"))
    sent = table(out.union(back).distinct().withColumn("place", F.col("component")), "sent")
    links = links.union(links_sent(docs, classes, sent, k, num, den, held))
    free(sent)
    return links


def shared_tokens(wide: DataFrame, tokens: str) -> DataFrame:
    """Rows (node, n, pos, token, hub) of the tokens that more than one set has. hub: the first set that has the token."""
    rows = wide.select("node", "n", F.posexplode(tokens).alias("pos", "token"))
    # Holders meet on the map side first, so a token that a third of all sets have is no burden; then only shared ones have a row.
    found = rows.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
    shared = table(found.select("token", "hub"), "shared")
    out = table(rows.join(shared, "token"), "rows")
    free(shared)
    return out


def near_hubs(shares: DataFrame, lowest: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (u, v) of sets to hubs that hold at least half of either's prefix, of rare tokens or of the lowest.

    shares(node, n, hub, k): k shared tokens of the rare prefix have that hub. lowest: shared_tokens() of the lowest. Both
    orders are needed: where what sets share is frequent everywhere, their rare tokens are those they don't share.
    """
    own = shares.where("node = hub").select("hub", F.col("n").alias("hub_n"))  # the hub of a token has it too
    near = shares.where("node <> hub").join(own, "hub").where(F.col("k") * 2 >= F.least(prefix_of("n", num, den), prefix_of("hub_n", num, den)))
    low = lowest.where("node <> hub").groupBy("node", "n", "hub").agg(F.count("*").alias("k")).where(F.col("k") * 2 >= F.least(F.col("n"), F.lit(LOWEST)))
    return near.select(F.col("node").alias("u"), F.col("hub").alias("v")).union(low.select("node", "hub"))


def grown(clusters: DataFrame, lowest: DataFrame) -> DataFrame:
    """clusters(id, component), joined by each set that has half its lowest tokens in common with one cluster: for each token the one that most holders are of."""
    own = lowest.select("node", "n", "token").join(sized(clusters.withColumnRenamed("id", "node")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = table(own, "held")
    main = own.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("kinds"))
    main = table(main.where("kinds > 1").drop("kinds"), "main")
    near = own.join(main, "token").groupBy("node", "n", "component", "main").agg(F.count("*").alias("k")).where(F.col("k") * 2 >= F.least(F.col("n"), F.lit(LOWEST))).where("component <> main")
    out = table(connected_components(clusters.select(F.col("id").alias("u"), F.col("component").alias("v")).union(near.select("node", "main"))), "clusters")
    free(own, main, clusters)
    return out


def prefix_pairs(rows: DataFrame, counts: DataFrame, clusters: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets of different clusters that the order of rare tokens lets pass. rows: shared_tokens(), deleted as soon as it is read; counts(node, n, c): how many of them a set has.

    Linked sets have sizes n, m within the limit and share at least s = min(prefix(n) - n, prefix(m) - m) + overlap tokens of
    their prefixes; the first shared one has n - overlap tokens before it at most, and m - overlap. So a set with fewer
    tokens that sets of other clusters have, than any partner's size asks for, is in no pair.
    """
    fewest = F.expr(f"((({num}L * n + {den - 1}) div {den}) * {den - num}L div {EXTRA * den}) + 1")
    own = clusters.withColumnRenamed("id", "node")
    able = table(counts.where(F.col("c") >= fewest).join(own, "node", "left").select("node", "c", F.coalesce("component", "node").alias("component")), "able")
    left = table(rows.select("node", "n", "pos", "token").join(sized(able), "node"), "able_rows")
    free(rows, able)
    for _ in range(ROUNDS):
        mixed = table(left.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token"), "mixed")
        kept = table(left.drop("c").join(mixed, "token", "left_semi"), "kept")
        free(left, mixed)
        left = table(kept.join(kept.groupBy("node").agg(F.count("*").alias("c")), "node").where(F.col("c") >= fewest), "able_rows")
        free(kept)
    # Of a token's rows, those of its most common cluster need no partner among themselves.
    main = left.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    before, left = left, table(left.join(main, "token").withColumn("other", F.col("component") != F.col("main")).drop("main"), "marked")
    free(before)
    x = left.where("other").select("token", *(F.col(c).alias(f"{c}_x") for c in ("node", "n", "component", "pos", "c")))
    overlap = overlap_of("n", "n_x", num, den)
    enough = F.least(prefix_of("n", num, den) - F.col("n"), prefix_of("n_x", num, den) - F.col("n_x")) + overlap
    pairs = left.join(x, "token").where(
        (F.col("component") != F.col("component_x")) & (~F.col("other") | (F.col("node") < F.col("node_x"))) & (den * F.least("n", "n_x") >= num * F.greatest("n", "n_x"))
        & (F.least("c", "c_x") >= enough) & (F.col("pos") <= F.col("n") - overlap) & (F.col("pos_x") <= F.col("n_x") - overlap)
    )
    pairs = table(pairs.select(F.greatest("node", "node_x").alias("a"), F.least("node", "node_x").alias("b")).distinct(), "prefix_pairs")
    free(left)
    return pairs


def screen(pairs: DataFrame, prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose prefixes share enough tokens. prefixes(node, n, prefix): under one order, as numbers or as their bytes."""
    for side in ("a", "b"):
        pairs = pairs.join(prefixes.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("prefix").alias(f"{side}_p")), side)
    out = batches({"a": pa.int64(), "b": pa.int64()})

    def run(it: Batches) -> Batches:
        for x in it:
            keep = []
            for n, m, p, q in zip(*(x.column(c).to_pylist() for c in ("a_n", "b_n", "a_p", "b_p"))):
                p, q = (np.frombuffer(t, np.int64) if isinstance(t, bytes) else np.array(t, np.int64) for t in (p, q))
                overlap = -(-num * (n + m) // (num + den))
                keep.append(len(np.intersect1d(p, q, assume_unique=True)) >= min(len(p) - n, len(q) - m) + overlap)
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return table(pairs.select("a", "b", "a_n", "b_n", "a_p", "b_p").mapInArrow(run, ddl(out)), "screened")


def ends_of(pairs: DataFrame) -> DataFrame:
    return table(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ends")


def near_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Components of documents linked by Jaccard >= num/den of their sets of k-word shingles.

    Words are runs without ASCII white space, A-Z lower-cased. Input: doc_id, text; other columns are ignored. Null and
    empty texts have no words: n_shingles 0, linked with nothing, component_id their own doc_id. Texts of fewer than k
    words are one shingle. Rows that repeat are of one class. A null doc_id takes part and never names a component unless
    all of it are null. Returns one row per input row: doc_id, row_key, n_shingles, component_id. Empty in, empty out.
    """
    least = least_set(num, den)
    total = docs.count()
    each = table(signatures(docs, common_words(docs, total), k, num, den), "signatures")
    # Of equal sets the first row stands for all; prefixes, the bulk of the rows, are not shuffled for that.
    classes = table(each.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.min_by("row_key", "row").alias("row_key"), F.count("*").alias("c"), F.first("n").alias("n")), "classes")
    again = each.select("node", "row").join(sized(table(classes.where("c > 1").select(F.col("node").alias("c_node"), F.col("row").alias("c_row")), "repeated")), (F.col("node") == F.col("c_node")) & (F.col("row") != F.col("c_row")), "left_semi")
    again = table(again.select("row"), "again")
    wide = each.where(F.col("n") >= least).join(sized(again), "row", "left_anti")
    rows = shared_tokens(wide, "rare")
    shares = table(rows.groupBy("node", "n", "hub").agg(F.count("*").alias("k")), "shares")
    lowest = shared_tokens(wide, "low")
    clusters = table(connected_components(near_hubs(shares, lowest, num, den)), "clusters")
    for _ in range(ROUNDS):
        clusters = grown(clusters, lowest)
    counts = table(shares.groupBy("node", "n").agg(F.sum("k").alias("c")), "counts")
    free(shares, lowest)
    pairs = prefix_pairs(rows, counts, clusters, num, den)
    free(counts)
    # The orders meet: what the rare tokens let pass must pass upwards and downwards too.
    ends = ends_of(pairs)
    pairs = screen(pairs, only(wide.select("node", "n", F.col("rare").alias("prefix")), ends, "node"), num, den)
    each, before = table(each.select("doc_id", "row_key", "n", "node"), "each"), each
    free(before, again, ends)
    both, size = sets_of(docs, classes, ends_of(pairs), k, (num, den)), prefix_of("n", num, den).cast("int") * 8
    for start in (F.lit(1), size + 1):
        pairs = screen(pairs, both.select("node", "n", F.substring("tokens", start, size).alias("prefix")), num, den)
    free(both)
    # What passes joins clusters, so that every pair left to compare lies within one.
    clusters = table(connected_components(clusters.select(F.col("id").alias("u"), F.col("component").alias("v")).union(pairs.select("a", "b"))), "clusters")
    held = max(HELD_BYTES, (classes.agg(F.sum(F.col("n").cast("long") * 8)).first()[0] or 0) // HELD_SHARE)
    links = links_within(docs, classes, clusters, k, num, den, held)
    final = sized(table(connected_components(links), "components"))
    names = classes.select("node", "rep").join(final.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = table(names, "names")
    smallest = table(names.groupBy("component").agg(F.min("rep").alias("component_id")), "smallest")
    named = table(names.join(sized(smallest), "component").select(F.col("node").alias("c_node"), "component_id"), "named")
    named = sized(named)
    return each.join(named, each["node"] == named["c_node"], "left").select(
        "doc_id", "row_key", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, all columns, with one row of each group: that of the smallest doc_id. Rows without words stay.

    Of rows of a group that share the smallest doc_id, those with the smallest row_key stay.
    """
    each = table(near_groups(docs, k, num, den), "near")
    lead = F.col("n_shingles") > 0
    named = each.where(lead & F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = table(named.groupBy("component_id").agg(F.min("row_key").alias("first_key")), "first")
    # Few rows have another of their group and id before them; they and those of other ids go.
    again = named.join(first, named["component_id"].eqNullSafe(first["component_id"]) & (F.col("row_key") > F.col("first_key"))).select("doc_id", "row_key")
    gone = each.where(lead & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "row_key").union(again).distinct()
    return by_rows(docs, table(gone, "gone"), "left_anti")
