"""Exact deduplication over counting quotient filters.

Each input partition builds counting quotient filters of its documents' 64-bit fingerprints, one for each range of their
high bits; there are as many ranges as the number of documents asks for, so a filter stays small at any size. In a filter
the quotient, the next bits, is a home slot, and the remainder is what the slot holds. Filters of a range merge losslessly
by merging sorted remainders. Only fingerprints with a count above one go on to byte verification, where rows are grouped
by their whole normalised bytes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Batches, as_long, batches, by_rows, ddl, emit, has, members, row_key, table, texts

U = np.uint64
#: Documents a range of fingerprints has at most, about.
RANGE_ROWS = 500_000
#: Share of the home slots that are taken at most.
LOAD = 0.75


def once(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class CountingQuotientFilter:
    """A multiset of fingerprints of so many bits, exactly.

    A fingerprint's high bits are its home slot, the others are stored. Fingerprints of one home are a run, sorted; runs are
    in the order of their homes and move up where slots are taken. Three bits a slot tell the homes that have a run
    (occupied), the slots that go on a run (continued) and those away from home (shifted), which is enough to tell each
    slot's home again. Counts above one are kept beside.
    """

    def __init__(self, bits: int = 64, keys: np.ndarray = np.zeros(0, U), counts: np.ndarray = np.zeros(0, np.int64)):
        """keys: sorted and distinct, of so many bits; counts: how often each is in the multiset."""
        self.bits, n = bits, len(keys)
        self.quotient = min(bits, max(1, int(np.ceil(np.log2(max(2, n / LOAD))))))
        self.shift = U(bits - self.quotient)
        home = (keys >> self.shift).astype(np.int64) if self.quotient < 64 else keys.astype(np.int64)
        at = np.arange(n) + np.maximum.accumulate(home - np.arange(n)) if n else home
        slots = max(1 << self.quotient, int(at[-1]) + 1 if n else 0)
        self.remainders = np.zeros(slots, U)
        self.occupied, self.continued, self.shifted = (np.zeros(slots, bool) for _ in range(3))
        self.remainders[at] = keys & ((U(1) << self.shift) - U(1))
        self.occupied[home] = True
        self.continued[at[1:]] = home[1:] == home[:-1]
        self.shifted[at] = at != home
        often = counts > 1
        self.often, self.counts = at[often], counts[often]

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints, sorted, and their counts."""
        used = np.flatnonzero(self.occupied | self.continued | self.shifted)
        run = np.cumsum(~self.continued[used]) - 1
        counts = np.ones(len(self.remainders), np.int64)
        counts[self.often] = self.counts
        return (np.flatnonzero(self.occupied)[run].astype(U) << self.shift) | self.remainders[used], counts[used]

    @classmethod
    def merged(cls, bits: int, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        parts = [f.items() for f in filters]
        return cls(bits, *once(*(np.concatenate(x) for x in zip(*parts)))) if parts else cls(bits)

    def dump(self) -> bytes:
        """Remainders in as many bytes as they need, the three bits, the counts above one."""
        width = max(1, -(-int(self.shift) // 8))
        marks = np.packbits(np.concatenate([self.occupied, self.continued, self.shifted]))
        head = np.array([self.bits, self.quotient, len(self.remainders), len(self.often)], np.int64)
        return b"".join(x.tobytes() for x in (head, np.ascontiguousarray(self.remainders.view(np.uint8).reshape(-1, 8)[:, :width]), marks, self.often, self.counts))

    @classmethod
    def load(cls, data: bytes) -> CountingQuotientFilter:
        self, slots = cls.__new__(cls), int(np.frombuffer(data, np.int64, 1, 16)[0])
        self.bits, self.quotient, _, often = map(int, np.frombuffer(data, np.int64, 4))
        self.shift = U(self.bits - self.quotient)
        width, at = max(1, -(-int(self.shift) // 8)), 32
        wide = np.zeros((slots, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, slots * width, at).reshape(slots, width)
        self.remainders, at = wide.view(U).ravel(), at + slots * width
        marks = np.unpackbits(np.frombuffer(data, np.uint8, -(-3 * slots // 8), at), count=3 * slots).astype(bool)
        self.occupied, self.continued, self.shifted = marks.reshape(3, slots)
        at += -(-3 * slots // 8)
        self.often, self.counts = np.frombuffer(data, np.int64, often, at), np.frombuffer(data, np.int64, often, at + 8 * often)
        return self


def by_range(keys: np.ndarray, counts: np.ndarray, range_bits: int):
    """(range, filter of its fingerprints) of sorted distinct 64-bit fingerprints."""
    bits = 64 - range_bits
    of = (keys >> U(bits)).astype(np.int64) if range_bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    low = keys & ((U(1) << U(bits)) - U(1)) if range_bits else keys
    for i, j in zip(cuts, [*cuts[1:], len(keys)]):
        yield int(of[i]), CountingQuotientFilter(bits, low[i:j], counts[i:j])


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, row_key, fp (64-bit fingerprint), sha (SHA-256 of the normalised text)."""
    out = batches({"doc_id": pa.int64(), "row_key": pa.int64(), "fp": pa.int64(), "sha": pa.binary()})

    def run(it: Batches) -> Batches:
        for b in it:
            norm = [x.lower() for x in texts(b)]
            fp = np.fromiter(map(xxhash.xxh3_64_intdigest, norm), np.uint64, len(norm))
            yield emit(out, b.column("doc_id"), b.column("row_key"), as_long(fp), [hashlib.sha256(x).digest() for x in norm])

    return docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("row_key")).mapInArrow(run, ddl(out))


def repeated_fingerprints(digest: DataFrame) -> DataFrame:
    """(fp, n) of fingerprints that more than one document has, from merged filters. digest: a table with fp."""
    range_bits = max(8, math.ceil(math.log2(max(1, digest.count() / RANGE_ROWS))))
    part, merged = batches({"range": pa.int64(), "filter": pa.binary()}), batches({"fp": pa.int64(), "n": pa.int64()})

    def build(it: Batches) -> Batches:
        held, fresh = (np.zeros(0, U), np.zeros(0, np.int64)), []

        def settle():
            every = np.concatenate([held[0], *fresh])
            return once(every, np.concatenate([held[1], np.ones(len(every) - len(held[0]), np.int64)]))

        for b in it:
            fresh.append(b.column("fp").to_numpy().view(U))
            if sum(map(len, fresh)) > 1_000_000:
                held, fresh = settle(), []
        rows = [(q, f.dump()) for q, f in by_range(*settle(), range_bits)]
        for i in range(0, len(rows), 256):
            yield emit(part, *map(list, zip(*rows[i : i + 256])))

    def merge(key, group):
        every = CountingQuotientFilter.merged(64 - range_bits, [CountingQuotientFilter.load(x) for x in group.column("filter").to_pylist()])
        keys, counts = every.items()
        again = counts > 1
        fp = keys[again] | (U(key[0].as_py()) << U(64 - range_bits))
        return pa.table([pa.array(as_long(fp)), pa.array(counts[again])], schema=merged)

    return digest.select("fp").mapInArrow(build, ddl(part)).groupBy("range").applyInArrow(merge, ddl(merged))


def verified_groups(docs: DataFrame, again: DataFrame) -> DataFrame:
    """(sha, keep_id, n) of texts that more than one row has, compared byte by byte. docs(doc_id, text), again(fp)."""
    known = members(again, "fp")
    out = batches({"doc_id": pa.int64(), "fp": pa.int64(), "norm": pa.binary()})

    def route(it: Batches) -> Batches:
        for b in it:
            norm = [x.lower() for x in texts(b)]
            fp = as_long(np.fromiter(map(xxhash.xxh3_64_intdigest, norm), np.uint64, len(norm)))
            at = np.flatnonzero(has(known, fp)) if known is not None else np.arange(len(fp))
            if len(at):
                yield emit(out, b.column("doc_id").take(pa.array(at)), fp[at], [norm[i] for i in at])

    routed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(route, ddl(out))
    if known is None:
        routed = routed.join(again.select("fp"), "fp", "left_semi")
    # The bytes themselves are the key; copies meet on the map side first.
    same = routed.groupBy("fp", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    return same.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "n")


def find_copies(docs: DataFrame) -> DataFrame:
    """Groups of documents whose texts are identical after lower-casing A-Z.

    Input: doc_id, text; other columns are ignored. Null text counts as empty, so all null and empty texts are one group.
    Returns one row per input row: doc_id, row_key, keep_id (largest doc_id of the group; null only if every doc_id of it
    is null), group_size, kept, sha. Rows that repeat in doc_id and text are both kept here; see drop_copies(). An empty
    table gives an empty result.
    """
    digest = table(digests(docs), "digests")
    again = table(repeated_fingerprints(digest), "again")
    groups = table(verified_groups(docs, again), "groups")
    g = groups.select(F.col("sha").alias("g_sha"), "keep_id", "n")
    # Both sides are tables, so a sha that a third of the rows has is split by adaptive execution.
    return digest.join(g, digest["sha"] == g["g_sha"], "left").select(
        "doc_id", "row_key",
        F.when(F.col("n").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("n").isNotNull(), F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(F.lit(True)).alias("kept"),
        "sha",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept; of rows that repeat in doc_id and text, any one."""
    found = table(find_copies(docs), "copies")
    rest = by_rows(docs, found.where("not kept").select("doc_id", "row_key").distinct(), "left_anti")
    twice = table(found.where("kept").groupBy("doc_id", "row_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "row_key"), "twice")
    if twice.isEmpty():
        return rest
    return by_rows(rest, twice, "left_anti").union(by_rows(rest, twice, "left_semi").dropDuplicates(["doc_id", "text"]))
