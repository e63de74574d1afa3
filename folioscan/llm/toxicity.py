"""Toxicity scores from a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs to Latin letters, strips accents, reads digits as the letters they stand for and
turns everything else into spaces, one character for one, so hits keep their offsets. The automaton holds whole words and
word beginnings (inflected forms share them) with weights, and exception phrases that void the hits inside them. Hits are
counted once for each word, summed by weight and normalised by length; a logistic curve over these gives the score.

Weights and curve are learned from a bounded sample of labelled rows (SAMPLE_ROWS, by a hash of doc_id); without
labels the default lexicon and curve hold.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Batches, batches, ddl, emit, strings
from .ngram_join import ODD, WordHashes, shingles

#: At most so many labelled rows are read to learn from.
SAMPLE_ROWS, SAMPLE_CHARS = 4096, 20_000

# Cyrillic, Greek and other letters that look like Latin ones; letters without a decomposition; digits and
# signs that stand for letters. l, i, 1 and | share one symbol since each is written for the others.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "ӏ": "i", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g",
    "ß": "s", "æ": "a", "ø": "o", "ł": "i", "đ": "d", "ð": "d", "þ": "p", "œ": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i"}
#: Words of common abuse and their default weights.
LEXICON = {"idiot": 3.0, "moron": 3.0, "stupid": 2.0, "loser": 2.0, "pathetic": 2.0, "scum": 3.0, "worthless": 2.5, "disgusting": 2.0, "trash": 1.5, "clown": 1.5, "imbecile": 3.0, "retard": 3.0, "bastard": 3.0, "asshole": 3.5, "bitch": 3.5, "fuck": 3.5, "shit": 2.5, "whore": 3.5, "vermin": 2.5, "filth": 2.0}
EXCEPTIONS = ("trash can", "trash bin", "pond scum", "clown fish", "class clown", "idiot proof", "white trash bag")
NOT_A_WORD = re.compile(r"[@$|](?![^\W\d_])|(?<![^\W\d_])[@$|]")


class FoldTable(dict):
    def __missing__(self, cp: int) -> str:
        low = chr(cp).lower()[:1]
        base = unicodedata.normalize("NFKD", low)[:1].lower()
        c = HOMOGLYPHS.get(low) or HOMOGLYPHS.get(base) or base
        c = DIGITS.get(c, c)
        self[cp] = c = c if c.isalnum() else " "
        return c


FOLDS = FoldTable()


def fold(text: str) -> str:
    """As long as text; letters and digits folded, all else space."""
    if "$" in text or "@" in text or "|" in text:
        text = NOT_A_WORD.sub(" ", text)
    return text.translate(FOLDS)


@dataclass
class Model:
    """terms: folded, from a leading space; those that also end in one are whole words, others beginnings of words."""

    terms: dict[str, float] = field(default_factory=lambda: {f" {fold(w)} ": v for w, v in LEXICON.items()})
    exceptions: tuple[str, ...] = tuple(f" {fold(x)} " for x in EXCEPTIONS)
    curve: tuple[float, ...] = (-3.0, 2.0, 0.8, 0.3, 0.3)

    def automaton(self):
        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (len(t), w, t))
        for x in self.exceptions:
            a.add_word(x, (len(x), None, x))
        a.make_automaton()
        return a


def hits(automaton, folded: str) -> list[tuple[int, int, float, str]]:
    """(start, end, weight, term), the weightiest of each word, outside exception phrases."""
    best, exempt = {}, []
    for end, (n, w, t) in automaton.iter(f" {folded} "):
        start = end - n + 1  # of the leading space, which is one to the left in the padded text
        if w is None:
            exempt.append((start, start + n - 2))
        elif start not in best or w > best[start][2]:
            best[start] = (start, start + len(t.strip()), w, t.strip())
    return [h for h in best.values() if not any(a <= h[0] and h[1] <= b for a, b in exempt)]


def features(found: list, words: int) -> list[float]:
    total = sum(h[2] for h in found)
    return [1.0, float(bool(found)), math.log1p(total), math.log1p(100 * total / max(1, words)), max((h[2] for h in found), default=0.0)]


def score(curve, rows: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(rows @ np.asarray(curve), -30, 30)))


def candidates(folded: str) -> set[str]:
    """Every word, and the beginnings of 4 to 7 letters of longer words."""
    out = set()
    for w in set(folded.split()):
        if 3 <= len(w) <= 24:
            out.add(f" {w} ")
        for k in range(4, min(7, len(w) - 1) + 1):
            out.add(f" {w[:k]}")
    return out


def fit(texts: list[str], labels: list[int]) -> Model:
    """Learns terms that label 1 has and label 0 lacks, then the curve. Near copies count once, or their own rare words would pass for abuse."""
    if not any(labels) or all(labels):
        return Model()
    sets, kept, seen = [fold(t) for t in texts], [], set()
    cache = WordHashes()
    for i, s in enumerate(sets):
        tokens, _ = shingles(cache.of(s.encode()), 3)
        mins = {(j, int((tokens * ODD[8 + j]).min())) for j in range(6)} if len(tokens) else set()
        if len(mins & seen) < 2:
            kept.append(i)
        seen |= mins
    pos, neg = [i for i in kept if labels[i]], [i for i in kept if not labels[i]]
    inside = {i: candidates(sets[i]) for i in pos}
    have, lack = Counter(c for i in pos for c in inside[i]), Counter()
    have = {c: n for c, n in have.items() if n >= 3}
    for i in neg:
        lack.update(c for c in candidates(sets[i]) if c in have)
    share, most = len(pos) / max(1, len(kept)), math.log(max(2, len(have) * 100))
    weight = {c: math.log((n + 0.5) / (len(pos) + 1)) - math.log((lack[c] + 0.5) / (len(neg) + 1)) for c, n in have.items()}

    def surprise(n: int, of: int) -> float:
        p = n / of
        return of * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0)) if p > share else 0.0

    sure = {c for c, n in have.items() if n / (n + lack[c]) >= 0.7 and surprise(n, n + lack[c]) >= most}
    # Of a chain of beginnings in the same documents only the longest counts: it hits the fewest other words.
    sure -= {c for c in sure if any(have.get(e) == have[c] for e in (t[:k] for t in sure if t.startswith(c) for k in range(len(c) + 1, len(t) + 1)) if e in sure)}
    # Beyond those: beginnings or words that cover label 1 where no sure term does, most first.
    default = Model()
    known = sure | set(default.terms)
    open_ = {i for i in pos if not inside[i] & known}
    extra = set()
    near = {c: {i for i in open_ if c in inside[i]} for c, n in have.items() if n / (n + lack[c]) >= 0.9 and c not in sure} if open_ else {}
    while near:
        c = max(near, key=lambda c: (len(near[c]), have[c] / (have[c] + lack[c]), len(c), c))
        if len(near[c]) < 3:
            break
        extra.add(c)
        gone = near.pop(c)
        near = {k: v - gone for k, v in near.items() if len(v - gone) >= 3}
    terms = default.terms | {c: min(6.0, weight[c]) for c in sure | extra if weight[c] > 0.5}
    model = Model(terms, default.exceptions)
    automaton = model.automaton()
    x = np.array([features(hits(automaton, s), len(s.split())) for s in sets])
    y, b = np.asarray(labels, float), np.zeros(5)
    for _ in range(30):  # Newton's method with a small ridge
        p = score(b, x)
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(5), x.T @ (y - p) - 0.05 * b)
    model.curve = tuple(float(v) for v in b)
    return model


def held_out():
    """True where crc32 of doc_id as text leaves 0 by 5; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most rows of the labelled documents that are not held out, of at most SAMPLE_CHARS characters each; longer ones are scored, not learned from.

    Null labels are passed over; of a doc_id labelled twice the larger label counts. Null texts are empty ones. Without
    labels, or of one label alone, the fixed lexicon and curve hold.
    """
    pick = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    pick = pick.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    if not pick:
        return Model()
    few = F.broadcast(docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in pick], "l_id long, l_toxic int"))  # at most rows
    got = docs.select(F.col("doc_id").cast("long"), "text").where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).join(few, F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "l_toxic").toArrow()
    every = sorted(zip(got.column(0).to_pylist(), [x or "" for x in got.column(1).to_pylist()], got.column(2).to_pylist()))
    return fit([x[1] for x in every], [x[2] for x in every])


def rate(it: Batches, model: Model):
    """Each batch with its scores and hits."""
    automaton = model.automaton()
    for b in it:
        found, rows = [], []
        for t in strings(b):
            s = fold(t)
            h = hits(automaton, s)
            found.append(h)
            rows.append(features(h, len(s.split())))
        yield b, score(model.curve, np.array(rows).reshape(-1, 5)), found


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5), n_hits, terms (of the hits, with start:end).

    Only text decides. Null and empty texts have the score of no hits. Repeated rows are scored alike; extra columns are
    ignored. Empty in, empty out.
    """
    out = batches({"doc_id": pa.int64(), "held_out": pa.bool_(), "score": pa.float64(), "predicted": pa.int32(), "n_hits": pa.int64(), "terms": pa.string()})

    def run(it: Batches) -> Batches:
        for b, s, found in rate(it, model):
            terms = [" ".join(f"{h[3]}:{h[0]}:{h[1]}" for h in sorted(f)) for f in found]
            yield emit(out, b.column("doc_id"), b.column("held_out"), s, (s >= 0.5).astype(np.int32), [len(f) for f in found], terms)

    return docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out")).mapInArrow(run, ddl(out))


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic. Null and empty texts stay; repeated rows are judged alike; empty in, empty out."""

    def run(it: Batches) -> Batches:
        for b, s, _ in rate(it, model):
            yield b.filter(pa.array(s < 0.5))

    return docs.mapInArrow(run, docs.schema)
