"""Packing documents into sequences by column generation for the cutting-stock problem.

Documents are cut at multiples of the capacity; what is left of each is a piece of 1..capacity tokens. The lengths'
histogram (at most capacity numbers, whatever the corpus) is the demand of a cutting-stock problem: a linear program over
patterns (multisets of lengths that fit a sequence), whose columns a knapsack by dynamic programming prices. The
solution is rounded down; what demand is left is filled by best fit. Pieces are ranked within their length, and a
piece's length and rank give its pattern, the copy of the pattern and its offset there by arithmetic alone.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

from ._shared import Batches, batches, ddl, emit, strings, table, trim

CAPACITY = 1024
#: Pieces of a length that are ranked in one place, about.
RANKED = 100_000
#: A cut is worth so many tokens of padding.
CUT_COST = 4.0

#: Texts with characters beyond, or with a special token's string, go to the tokenizers library; for others its ids are those of tiktoken over the same ranks, four times as fast.
BEYOND = "[^\x00-ɏ]"


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, from a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        # The file writes printable bytes as themselves and numbers the others from U+0100 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(c): c for c in shown} | {chr(0x100 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.slow = re.compile("|".join([BEYOND, *map(re.escape, sorted(special))]))
        ranks = {bytes(byte[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.whole(text) if self.slow.search(text) else np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def padded(total: int, capacity: int = CAPACITY) -> int:
    """Length of a sequence of total tokens: capacity, except at a power of two."""
    return total if total & (total - 1) == 0 else capacity


def price(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of a multiset of lengths for each exact total, and the last length's index in it."""
    best, last = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
    best[0] = 0
    fit = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for f in range(1, capacity + 1):
        if n := fit[f]:
            v = best[f - lengths[:n]] + values[:n]
            last[f] = i = int(v.argmax())
            best[f] = v[i]
    return best, last


def relax(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of a basis of the linear program within gap of its optimum, and how often each is used.

    A column is a pattern over lengths, or one cut: a piece beyond capacity / 2 spent to make one of capacity / 2 and the rest.
    """
    m, half = len(lengths), capacity // 2
    full = np.array([0] + [padded(f, capacity) for f in range(1, capacity + 1)], float)
    cuts = [(np.flatnonzero(lengths == n)[0], np.flatnonzero(lengths == half)[0], np.flatnonzero(lengths == n - half)[0]) for n in lengths[lengths > half]]
    whole_at, half_at, rest_at = np.array(cuts, np.int64).reshape(-1, 3).T
    # Start: every long piece cut, of every short one as many as fit and what fills the gap exactly while there is enough of it.
    columns, cost, x, rest, at = np.zeros((m, m), np.int32), np.zeros(m), np.zeros(m), demand.copy(), {int(n): j for j, n in enumerate(lengths)}
    for j in range(m - 1, -1, -1):
        n = int(lengths[j])
        if n > half:
            columns[j, j], cost[j], x[j] = 1, CUT_COST, rest[j]
            for k in (at[half], at[n - half]):
                columns[k, j] -= 1
                rest[k] += x[j]
            continue
        copies, gap_at = capacity // n, at.get(capacity % n)
        columns[j, j], x[j] = copies, rest[j] / copies
        if gap_at is not None and rest[gap_at] >= x[j]:
            columns[gap_at, j] += 1
            rest[gap_at] -= x[j]
        cost[j] = padded(int(columns[:, j] @ lengths), capacity)
    inverse = np.linalg.inv(columns)
    for _ in range(most):
        dual = cost @ inverse
        best, last = price(lengths, dual, capacity)
        ratio = best[1:] / full[1:]
        f = int(np.argmax(best[1:] - full[1:])) + 1
        gains = dual[whole_at] - dual[half_at] - dual[rest_at] - CUT_COST
        cut = int(gains.argmax()) if len(gains) else -1
        a = np.zeros(m, np.int32)
        if cut >= 0 and gains[cut] > max(1e-7 * capacity, best[f] - full[f]):
            a[[half_at[cut], rest_at[cut]]] -= 1
            a[whole_at[cut]] += 1
            price_of = CUT_COST
        elif best[f] - full[f] <= 1e-7 * capacity or ((not len(gains) or gains[cut] <= 0) and (cost @ x) * (1 - 1 / max(1.0, ratio.max())) <= gap * (cost @ x)):
            break
        else:
            left, price_of = f, full[f]
            while left:
                a[last[left]] += 1
                left -= lengths[last[left]]
        d = inverse @ a
        ok = d > 1e-9
        theta = np.full(m, np.inf)
        theta[ok] = x[ok] / d[ok]
        r = int(theta.argmin())
        step = theta[r]
        x = np.maximum(x - step * d, 0)
        x[r] = step
        inverse[r] /= d[r]
        row = inverse[r].copy()
        d[r] = 0
        nz, cz = np.flatnonzero(np.abs(d) > 1e-12), np.flatnonzero(row)
        inverse[np.ix_(nz, cz)] -= np.outer(d[nz], row[cz])
        columns[:, r], cost[r] = a, price_of
    return columns, x


@dataclass
class Plan:
    """Patterns in order: pattern p takes counts[p] sequences from first[p] on. slots: (length, rank from, pattern, copies of the length in it, offset of the first).

    cuts[n]: so many pieces of length n, the first ones by rank, are cut at capacity / 2. Of a length, the uncut come first
    by rank, then the halves (from heads[n] on) or rests of cut ones.
    """

    first: np.ndarray
    counts: np.ndarray
    slots: np.ndarray
    cuts: np.ndarray
    uncut: np.ndarray
    heads: np.ndarray


def plan(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = 0.003, most: int = 400) -> Plan:
    """Patterns for all pieces of a histogram of lengths 1..capacity."""
    found: list[tuple[dict[int, int], int]] = []
    half, b = capacity // 2, np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        b[n] = c
    cuts, uncut = np.zeros_like(b), b.copy()
    if b[capacity]:
        found.append(({capacity: 1}, int(b[capacity])))
    demand = b.copy()
    demand[capacity] = 0
    if demand.any():
        lengths = np.flatnonzero(demand)
        lengths = np.unique(np.concatenate([lengths, lengths[lengths > half] - half, [half] if (lengths > half).any() else []]).astype(np.int64))
        columns, x = relax(lengths, demand[lengths].astype(float), capacity, gap, most)
        is_cut = (columns < 0).any(0)
        want = np.zeros(capacity + 1)
        for c in np.flatnonzero(is_cut):
            want[lengths[columns[:, c] > 0][0]] += x[c]
        cuts = np.minimum(np.diff(np.floor(np.cumsum(want) + 0.5).astype(np.int64), prepend=0), b)  # rounded, in sum too
        demand -= cuts
        uncut = demand.copy()
        uncut[capacity] = b[capacity]
        demand[half] += cuts.sum()
        demand[: half] += np.concatenate([[0], cuts[half + 1 : capacity]])
        demand = demand[lengths]
        columns, x = columns[:, ~is_cut], x[~is_cut]
        whole = np.floor(x + 1e-9).astype(np.int64)
        rest = demand - columns @ whole
        for j in np.flatnonzero(rest < 0):  # by rounding errors only
            while rest[j] < 0:
                c = int(np.flatnonzero((columns[j] > 0) & (whole > 0))[0])
                whole[c] -= 1
                rest += columns[:, c]
        for c in np.argsort(whole - x, kind="stable"):  # round up what still fits
            if x[c] > whole[c] and (columns[:, c] <= rest).all():
                whole[c] += 1
                rest -= columns[:, c]
        for c in np.flatnonzero(whole):
            found.append(({int(lengths[j]): int(columns[j, c]) for j in np.flatnonzero(columns[:, c])}, int(whole[c])))
        while rest.any():  # best fit: the longest piece, then what fills the sequence closest
            pattern, room, n = {}, capacity, rest.copy()
            while room and len(at := np.flatnonzero((n > 0) & (lengths <= room))):
                j = at[-1]
                if pattern:  # two pieces that fill the room exactly beat the longest one
                    want = room - lengths[at]
                    k = np.minimum(np.searchsorted(lengths, want), len(lengths) - 1)
                    exact = at[(want > 0) & (lengths[k] == want) & (n[k] > (k == at))]
                    if lengths[j] != room and len(exact):
                        j = exact[-1]
                pattern[int(lengths[j])] = pattern.get(int(lengths[j]), 0) + 1
                n[j] -= 1
                room -= int(lengths[j])
            used = rest - n
            times = int((rest[used > 0] // used[used > 0]).min())
            rest -= used * times
            found.append((pattern, times))
    counts = np.array([c for _, c in found], np.int64)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
    at: dict[int, int] = {}
    slots = []
    for p, (pattern, n) in enumerate(found):
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            slots.append((length, at.get(length, 0), p, copies, offset))
            at[length] = at.get(length, 0) + copies * n
            offset += copies * length
    return Plan(first, counts, np.array(sorted(slots), np.int64).reshape(-1, 5), cuts, uncut, uncut[half] + np.concatenate([[0], np.cumsum(cuts)[:-1]]))


def place(p: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by their length and rank (from 0) within it."""
    key = p.slots[:, 0] * (1 << 44) + p.slots[:, 1]
    at = p.slots[np.searchsorted(key, length * (1 << 44) + rank, "right") - 1]
    k = rank - at[:, 1]
    return p.first[at[:, 2]] + k // at[:, 3], at[:, 4] + k % at[:, 3] * length


def place_all(p: Plan, length: np.ndarray, rank: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, ...]:
    """Of pieces by length and rank: (row, start within the piece, length, sequence, offset), two rows for a cut piece."""
    half, row = capacity // 2, np.arange(len(length))
    cut = rank < p.cuts[length]
    n, r = length[cut], rank[cut]
    rows = np.concatenate([row[~cut], row[cut], row[cut]])
    start = np.concatenate([np.zeros((~cut).sum(), np.int64), np.zeros(len(n), np.int64), np.full(len(n), half)])
    size = np.concatenate([length[~cut], np.full(len(n), half), n - half])
    own = np.concatenate([(rank - p.cuts[length])[~cut], p.heads[n] + r, p.uncut[n - half] + r])
    return rows, start, size, *place(p, size, own)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, head_crc32, rest_crc32): each document's ids and the closing 0, cut at multiples of capacity. head and rest: of the first capacity / 2 ids and of the others."""
    half = 4 * (capacity // 2)
    out = batches(dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "head_crc32", "rest_crc32"), pa.int64()))

    def run(it: Batches) -> Batches:
        encoder = encoder_of(vocabulary)
        for b in it:
            rows = []
            for i, ids in zip(b.column("doc_id").to_pylist(), map(encoder.encode, strings(b))):
                ids += b"\0\0\0\0"
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    x = ids[4 * s : 4 * (s + capacity)]
                    head = zlib.crc32(x[:half])
                    rows.append((i, s, len(x) // 4, zlib.crc32(x[half:], head), n, head, zlib.crc32(x[half:])))
            if rows:
                yield emit(out, *map(list, zip(*rows)))
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl(out))


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Input: doc_id, text; other columns are ignored. Null and empty texts are the closing id alone. Rows that repeat are
    packed as often as they occur. A null doc_id is kept. A special token's string in a text is that token, as the
    tokenizer has it.
    Sequence ids are 0, 1, ... without gaps; which piece of a length comes where follows the order of the
    input. Empty in, empty out.
    """
    cut = table(pieces(docs, vocabulary, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    # A length's pieces are ranked in as many places as it needs, dealt by their row numbers. Places are numbered through.
    places = np.array([0] + [1 + histogram.get(n, 0) // RANKED for n in range(1, capacity + 1)])
    first = np.concatenate([[0], np.cumsum(places)[:-1]])

    def by_length(values: np.ndarray) -> Column:
        return F.element_at(F.array(*(F.lit(int(v)) for v in values[1:])), F.col("length").cast("int"))

    cut = cut.withColumn("place", (by_length(first) + F.pmod(F.xxhash64("row"), by_length(places))).cast("long"))
    starts = np.zeros(places.sum(), np.int64)  # ranks before each place: capacity numbers, and one more for each RANKED pieces
    for r in cut.groupBy("place").count().collect():
        starts[r.place] = r["count"]
    starts = np.cumsum(starts) - starts
    starts -= np.repeat(starts[np.minimum(first[1:], len(starts) - 1)], places[1:])
    solved = plan(histogram, capacity)
    out = batches(dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), pa.int64()))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy("doc_id", "start", "row")).cast("long"))

    def run(it: Batches) -> Batches:
        for b in it:
            length, place, rank, whole, head, rest = (b.column(c).to_numpy() for c in ("length", "place", "rank", "ids_crc32", "head_crc32", "rest_crc32"))
            row, start, size, sequence, offset = place_all(solved, length, starts[place] + rank - 1, capacity)
            crc = np.where(size == length[row], whole[row], np.where(start == 0, head[row], rest[row]))
            at = pa.array(row)
            yield emit(out, b.column("doc_id").take(at), b.column("start").to_numpy()[row] + start, size, crc, b.column("doc_tokens").take(at), sequence, offset)

    return ranked.mapInArrow(run, ddl(out))
