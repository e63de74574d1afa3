"""Personal data by weak supervision.

Fixed patterns give base spans. Beside them, looser patterns propose further spans (numbers that ran together, written-out
addresses, national phone numbers, long numbers without a valid check digit). Labelers vote on every span: its form, a
validity rule, a gazetteer, and the words around. Expectation-maximisation over the counts of vote patterns, all
documents' and a bounded number of patterns, estimates each labeler's reliability and the probability of each pattern; a
logistic span classifier is trained on those. It decides which proposed spans are added; base spans stay.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Batches, batches, ddl, emit, strings, table

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# Where the base patterns can begin, so that a search takes time in proportion to the text: a match ends with the digits
# or the name it ends in, so no digit run is entered twice, and an address's name ends at its sign.
IP_SCAN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
NAME = string.ascii_letters + string.digits + "._%+-"
# Proposals: email written out; a card within digits that ran together; an international number within such a run; a national number.
WRITTEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?[(\[{]\s?at\s?[)\]}]\s?[A-Za-z0-9-]++(?:\s?(?:[(\[{]\s?dot\s?[)\]}]|\.)\s?[A-Za-z0-9-]++)+", re.I)
#: What every match of WRITTEN has.
BRACKETED = re.compile(r"[(\[{]\s?at", re.I)
CARD = re.compile(r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])|(?<![0-9])3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])")
INTERNATIONAL = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")
NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
# Gazetteers and context words.
DOMAINS = frozenset("com org net edu gov mil int info biz name io ai dev app co me tv uk us ca au nz ie de fr es it nl be at ch pl pt se no dk fi eu ru ua jp cn kr in br mx ar za".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|36|38")
CALLING = re.compile(r"1|7|20|27|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-9]|50[0-9]|59[0-9]|67[0-9]|69[0-9]|8[058][0-9]|9[679][0-9]")
NEAR = {
    "email": re.compile(r"mail|contact|write|reach|correo|courriel|kontakt", re.I),
    "ip": re.compile(r"\bip\b|addr|host|server|login|ping|from", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|pay|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|cell|fax|whatsapp|contact|anruf|appel|llam", re.I),
}
AWAY = {
    "email": re.compile(r"example of|regex|syntax", re.I),
    "ip": re.compile(r"version|release|section|chapter|build", re.I),
    "card": re.compile(r"isbn|order|serial|invoice|tracking|hash|barcode", re.I),
    "phone": re.compile(r"isbn|order|serial|invoice|version|score", re.I),
}
LABELERS = ("form", "valid", "gazetteer", "context", "edge")
ADD_FROM = 0.8


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d += d * (i % 2) - 9 * (i % 2 and d > 4)
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def passes(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(d) <= 3 and int(d or "0") <= 255 for d in (x.lstrip("0") for x in s.split(".")))
    if kind == "card":
        d = digits_of(s)
        return 13 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(digits_of(s)) <= 15


def emails(text: str):
    """(start, end) of addresses, leftmost non-overlapping. Each sign has one name before it at most, back to the address before."""
    free = 0
    for m in HOST.finditer(text):
        at = max(free, text.rfind("@", 0, m.start()) + 1)
        name = text[at : m.start()]
        start = at + len(name.rstrip(NAME))
        if start < m.start():
            free = m.end()
            yield start, free


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, leftmost non-overlapping for each kind; failing matches are dropped."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in IP_SCAN.finditer(text) if passes("ip", m.group())]
    out += [(2, *m.span()) for m in BASE["card"].finditer(text) if passes("card", m.group())]
    if "+" in text:
        out += [(3, *m.span()) for m in BASE["phone"].finditer(text) if passes("phone", m.group())]
    return out


def proposals(text: str, base: list) -> list[tuple[int, int, int]]:
    """Further spans that might be personal data, clear of all base spans and of each other."""
    found = [(0, m.span()) for m in WRITTEN.finditer(text)] if BRACKETED.search(text) else []
    found += [(2, m.span()) for m in CARD.finditer(text)] + [(3, m.span()) for m in INTERNATIONAL.finditer(text)] + [(3, m.span()) for m in NATIONAL.finditer(text)]
    taken, i, free, out = sorted((s, e) for _, s, e in base), 0, 0, []
    for k, (s, e) in sorted(found, key=lambda x: (x[1][0], x[0])):
        while i < len(taken) and taken[i][0] < e:  # base spans that begin before this one's end; those before it end by then or overlap
            free, i = max(free, taken[i][1]), i + 1
        if s >= free:
            out.append((k, s, e))
            free = e
    return out


def votes(text: str, k: int, s: int, e: int) -> str:
    """One of + 0 - for each labeler."""
    kind, span, d = KINDS[k], text[s:e], digits_of(text[s:e])
    around = text[max(0, s - 40) : s] + " " + text[e : e + 20]
    form = "+" if BASE[kind].fullmatch(span) else "-"
    if kind == "email":
        tail = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        valid, known = "+" if tail.isalpha() and len(tail) > 1 else "-", "+" if tail in DOMAINS else "-"
    elif kind == "ip":
        valid, known = "+" if passes("ip", span) else "-", "0" if span.split(".")[0] in ("0", "127", "255") else "+"
    elif kind == "card":
        valid, known = "+" if passes("card", span) else "-", "+" if ISSUERS.match(d) else "-"
    else:
        national = len(d) == 10 and "+" not in span
        valid = "+" if 9 <= len(d) <= 15 and not (national and d[0] in "01") else "-"
        known = ("+" if CALLING.match(d) else "-") if "+" in span else ("0" if d[0] in "23456789" and d[3] in "23456789" else "-")
    near, away = NEAR[kind].search(around), AWAY[kind].search(around)
    context = "+" if near and not away else "-" if away and not near else "0"
    edge = "-" if (s and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum()) else "+"
    return form + valid + known + context + edge


class SpanModel:
    """Probability of each (kind, votes): reliabilities by expectation-maximisation, then a logistic classifier on the posteriors."""

    def __init__(self, counts: dict[tuple[int, str], int], rounds: int = 50):
        self.reliability: dict[int, np.ndarray] = {}
        self.weights: dict[int, np.ndarray] = {}
        for k in range(len(KINDS)):
            rows = [(p, n) for (kind, p), n in sorted(counts.items()) if kind == k]
            if not rows:
                continue
            v = np.array([["-0+".index(c) for c in p] for p, _ in rows])
            n = np.array([c for _, c in rows], float)
            hot = np.eye(3)[v]  # pattern, labeler, vote
            post = np.clip(0.5 + 0.18 * (v - 1).sum(1) / len(LABELERS) * 2.5, 0.05, 0.95)  # majority
            for _ in range(rounds):
                prior = (n * post).sum() + 1.0, (n * (1 - post)).sum() + 1.0
                # Pseudo-counts that a labeler is more often right than wrong keep the two classes from changing places.
                yes = np.einsum("p,plv->lv", n * post, hot) + np.array([1.0, 1.0, 4.0])
                no = np.einsum("p,plv->lv", n * (1 - post), hot) + np.array([4.0, 1.0, 1.0])
                yes, no = yes / yes.sum(1, keepdims=True), no / no.sum(1, keepdims=True)
                odds = math.log(prior[0] / prior[1]) + np.einsum("plv,lv->p", hot, np.log(yes) - np.log(no))
                post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            self.reliability[k] = np.stack([no, yes])
            x = np.concatenate([np.ones((len(rows), 1)), hot.reshape(len(rows), -1)], 1)
            w, m = np.zeros(x.shape[1]), n / n.sum() * min(n.sum(), 1000.0)
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                w = w + np.linalg.solve((x * (m * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (m * (post - p)) - 0.1 * w)
            self.weights[k] = w

    def probability(self, k: int, pattern: str) -> float:
        if k not in self.weights:
            return 0.0
        x = np.concatenate([[1.0], np.eye(3)[["-0+".index(c) for c in pattern]].ravel()])
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[k], -30, 30))))


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added ones).

    Input: doc_id, text; other columns are ignored. Null text counts as empty; no span at all is an empty string. Rows that
    repeat are rows of their own. Offsets are code points, ends exclusive. Empty in, empty out.
    """
    seen = batches({"doc_id": pa.int64(), "base": pa.string(), "more": pa.string(), "patterns": pa.string()} | {f"n_{k}": pa.int64() for k in KINDS})

    def look(it: Batches) -> Batches:
        for b in it:
            rows = []
            for t in strings(b):
                base = base_spans(t) if re.search("[0-9@]", t) else []
                more = proposals(t, base) if re.search("[0-9]", t) or BRACKETED.search(t) else []
                marked = [(k, votes(t, k, s, e)) for k, s, e in base + more]
                count = [sum(x[0] == k for x in base) for k in range(len(KINDS))]
                rows.append((joined(base), ",".join(f"{k}:{s}:{e}:{v[1]}" for (k, s, e), v in zip(more, marked[len(base) :])), ",".join(f"{k}{v}" for k, v in marked), *count))
            if rows:
                yield emit(seen, b.column("doc_id"), *map(list, zip(*rows)))

    found = table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(look, ddl(seen)), "spans")
    counts: dict = defaultdict(int)
    # At most kinds x 3 ** labelers rows.
    for r in found.where("patterns <> ''").select(F.explode(F.split("patterns", ",")).alias("p")).groupBy("p").count().collect():
        counts[int(r.p[0]), r.p[1:]] = r["count"]
    model = SpanModel(counts)
    adds = {(k, p) for k, p in counts if model.probability(k, p) >= ADD_FROM}
    out = batches({"doc_id": pa.int64()} | {f"n_{k}": pa.int64() for k in KINDS} | {"base_sha256": pa.string(), "spans": pa.string()})

    def decide(it: Batches) -> Batches:
        for b in it:
            base, spans = b.column("base").to_pylist(), []
            for own, more in zip(base, b.column("more").to_pylist()):
                every = [(KINDS.index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in own.split(",") if x)]
                every += [(int(k), int(s), int(e)) for k, s, e, v in (x.split(":") for x in more.split(",") if x) if (int(k), v) in adds]
                spans.append(joined(every))
            yield emit(out, b.column("doc_id"), *(b.column(f"n_{k}") for k in KINDS), [hashlib.sha256(x.encode()).hexdigest() for x in base], spans)

    return found.drop("patterns").mapInArrow(decide, ddl(out))
