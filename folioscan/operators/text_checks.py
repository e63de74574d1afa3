"""Checks that scan text for patterns: typography, units, spacing, quotes, spelling, acronyms.

However many checks run, each text is read once, in one projection that finds the spans of all of them and cuts their
snippets; what matched is exploded, without the text, and only those rows are shuffled, once, by document, for first-wins
deduplication and the cap.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.text import blank, let, pattern, snippet, spans

CAP = 25
DASH = "–"

# Units that need a space before them. The typography list has a few more kinds than the grammar list.
GRAMMAR_UNITS = (
    "ms|µs|μs|ns|ps|fs|kg|mg|µg|μg|ng|km|cm|mm|nm|µm|μm|pm|MHz|GHz|kHz|THz|Hz|KB|MB|GB|TB|kB|PB|kW|MW|GW|mW|µW|μW|kV|MV|mV|µV|μV"
    "|mA|µA|μA|nA|dBm|dBi|dB|mmol|µmol|μmol|mol|mL|µL|μL|nL|dL|°C|°F|rad|sr|kPa|MPa|GPa|atm|bar|Pa|Bytes?|bits?"
)
TYPOGRAPHY_UNITS = (
    "ms|µs|μs|ns|ps|fs|kg|mg|µg|μg|ng|km|cm|mm|nm|µm|μm|pm|Å|MHz|GHz|kHz|THz|Hz|KB|MB|GB|TB|kB|PB|kW|MW|GW|mW|µW|μW|kV|MV|mV|µV|μV"
    "|mA|µA|μA|nA|dBm|dBi|dB|mT|µT|μT|mmol|µmol|μmol|mL|µL|μL|nL|dL|°C|°F|rad|sr|kPa|MPa|GPa|bar|atm|Pa|km/h|m/s|kΩ|MΩ|Ω|µF|μF|nF|pF|mH|µH|μH|nH"
)
DOI_PATH = r"(?:(?:https?://)?doi\.org/|doi:\s*)10\.\d{4,}[^\s]*"
BRACKETS = r"\[[^\]]{1,40}\]"
# Acronyms that need no definition.
SKIP_ACRONYMS = (
    "PDF", "URL", "HTTP", "HTTPS", "HTML", "CSS", "API", "XML", "JSON", "SQL", "TCP", "UDP", "IP", "DNS", "RAM", "ROM", "CPU", "GPU", "USB", "LAN",
    "WAN", "LED", "LCD", "OLED", "RGB", "HSV", "HSL", "GUI", "CLI", "SDK", "IDE", "FTP", "SSH", "SSL", "TLS", "VPN", "NAT", "MAC", "NIC", "SSD",
    "HDD", "OS", "VM", "IoT", "ICS", "IEEE", "ACM", "ISO", "ANSI", "IETF", "ITU", "NIST", "USA", "UK", "EU", "UN", "WHO", "DOI", "ISBN", "ISSN",
    "RMS", "SNR", "MIMO", "OFDM", "SINR", "BER", "QoS", "QoE", "CDMA", "FDMA", "TDMA", "WLAN", "WPAN", "WBAN", "AI", "ML", "DL", "NN", "ANN", "CNN",
    "RNN", "LSTM", "GRU", "GAN", "SVM", "KNN", "PCA", "NLP", "NLU", "NLG", "PSO", "ACO", "GA", "DE", "SA", "TS", "RMSE", "MAE", "MSE", "MAPE", "MASE",
    "AUC", "ROC", "MAP", "FPR", "TPR", "FNR", "TNR", "TP", "TN", "FP", "FN", "ACC", "SaaS", "PaaS", "IaaS", "SOA", "REST", "RPC", "VMs", "UTC", "GMT",
    "MAX", "MIN", "AVG", "STD", "FOR", "AND", "THE", "NOT", "ALL", "TWO", "ONE", "TEN", "NEW", "OLD", "LAB", "FIG", "TAB", "SEC", "EQN", "REF", "APP",
    "VRP", "VRPTW", "TSP", "ABC", "NaN", "INF",
)
# American and British forms.
SPELLINGS = (
    ("analyze", "analyse"), ("organization", "organisation"), ("organize", "organise"), ("recognize", "recognise"), ("optimize", "optimise"),
    ("minimize", "minimise"), ("maximize", "maximise"), ("characterize", "characterise"), ("utilize", "utilise"), ("realize", "realise"),
    ("emphasize", "emphasise"), ("prioritize", "prioritise"), ("parameterize", "parameterise"), ("analyzed", "analysed"), ("organized", "organised"),
    ("recognized", "recognised"), ("optimized", "optimised"), ("minimized", "minimised"), ("maximized", "maximised"), ("utilized", "utilised"),
    ("realized", "realised"), ("emphasized", "emphasised"), ("characterized", "characterised"), ("parameterized", "parameterised"),
    ("analyzing", "analysing"), ("organizing", "organising"), ("optimizing", "optimising"), ("utilizing", "utilising"), ("realizing", "realising"),
    ("color", "colour"), ("colors", "colours"), ("behavior", "behaviour"), ("behaviors", "behaviours"), ("neighbor", "neighbour"),
    ("labor", "labour"), ("honor", "honour"), ("humor", "humour"), ("favor", "favour"), ("flavor", "flavour"), ("center", "centre"),
    ("fiber", "fibre"), ("meter", "metre"), ("caliber", "calibre"), ("defense", "defence"), ("offense", "offence"), ("license", "licence"),
    ("catalog", "catalogue"), ("dialog", "dialogue"), ("analog", "analogue"), ("program", "programme"), ("modeling", "modelling"),
    ("traveling", "travelling"), ("labeled", "labelled"), ("fulfillment", "fulfilment"), ("enrollment", "enrolment"), ("skillful", "skilful"),
    ("artifact", "artefact"), ("artifacts", "artefacts"), ("sulfur", "sulphur"), ("gray", "grey"), ("aging", "ageing"),
    ("acknowledgment", "acknowledgement"),
)


@dataclass(frozen=True)
class Rule:
    """pattern; key: what counts as the same finding (default: its text). Callables take a hit: start, end, found, and g1 and g2, groups of the pattern over found alone."""

    pattern: str
    correct: Callable[[Column], Column] | None = None
    detail: Callable[[Column], Column] | None = None
    found: Callable[[Column], Column] | None = None
    kind: str | None = None
    key: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Check:
    check_id: str
    rules: tuple[Rule, ...]
    prepare: Callable[[Column], Column] | None = None
    width: int = 35
    dedupe: bool = True


class Hit:
    def __init__(self, span: Column, p: str):
        self.span, self.pattern = span, p

    def __getitem__(self, name: str) -> Column:
        return F.regexp_extract(self.span["found"], self.pattern, int(name[1])) if name in ("g1", "g2") else self.span[name]


def capped(rows: DataFrame, rules: int, cap: int = CAP, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """rows(doc_id, k, start, ...) of rules k = 0.. under the cap of a document, or of what by names, numbered by seq.

    The cap is tested after a finding is added and ends that rule only, so each later rule may still add one.
    """
    doc = Window.partitionBy(*by)
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "k").orderBy("start")))
    kept, keep = F.lit(0), F.lit(False)
    for k in range(rules):
        rows = rows.withColumn(f"_n{k}", F.count(F.when(F.col("k") == k, 1)).over(doc))
        allowed = F.greatest(F.lit(cap) - kept, F.lit(1))
        keep = keep | ((F.col("k") == k) & (F.col("_rank") <= allowed))
        kept = kept + F.least(F.col(f"_n{k}"), allowed)
    return rows.where(keep).withColumn("seq", F.row_number().over(doc.orderBy("k", "start"))).drop("_rank", *(f"_n{k}" for k in range(rules)))


FIELDS = {"check_id": "string", "k": "int", "start": "int", "key": "string", "kind": "string", "found": "string", "correct": "string", "snippet": "string", "detail": "string"}
HITS = "array<struct<" + ",".join(f"{n}:{t}" for n, t in FIELDS.items()) + ">>"


def hit(**values) -> Column:
    return F.struct(*((v if isinstance(v := values.get(n), Column) else F.lit(v)).cast(t).alias(n) for n, t in FIELDS.items()))


def hits_of(check: Check, scan: Column, text: Column) -> list[Column]:
    """An array of hits for each rule."""

    def array(k: int, r: Rule) -> Column:
        def row(s: Column) -> Column:
            x = Hit(s, r.pattern)
            made = {n: f(x) for n in ("correct", "detail", "found", "key") if (f := getattr(r, n))}
            found = made.pop("found", s["found"])
            key = made.pop("key", s["found"]) if check.dedupe else s["start"].cast("string")
            return hit(check_id=check.check_id, k=k, start=s["start"], key=key, kind=r.kind, found=found, snippet=snippet(text, s["start"], s["end"], check.width), **made)

        return F.transform(spans(scan, r.pattern), row)

    return [array(k, r) for k, r in enumerate(check.rules)]


def findings(docs: DataFrame, *names: str) -> DataFrame:
    """docs(doc_id, body) -> doc_id, check_id, seq, pos, kind, found, correct, snippet, detail of the named checks. Null bodies have no findings.

    Of the checks that look at a text as a whole, spelling has the American form in found and the British one in correct,
    with their snippets in snippet and detail.
    """
    checks = [CHECKS[n] for n in names if n in CHECKS]
    prepared = list(dict.fromkeys(c.prepare for c in checks if c.prepare))
    base = docs.select("doc_id", "body", *(f(F.col("body")).alias(f"_scan{i}") for i, f in enumerate(prepared)))
    text = F.col("body")
    arrays = [x for c in checks for x in hits_of(c, F.col(f"_scan{prepared.index(c.prepare)}") if c.prepare else text, text)]
    arrays += [f(text) for n, f in WHOLE.items() if n in names]
    rows = base.select("doc_id", F.explode(F.concat(*(F.coalesce(a.cast(HITS), F.array().cast(HITS)) for a in arrays))).alias("h")).select("doc_id", "h.*")
    # One exchange serves all windows.
    rows = rows.repartition("doc_id")
    first = Window.partitionBy("doc_id", "check_id", "key").orderBy("k", "start")
    rows = rows.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
    rows = capped(rows, max([1, *(len(c.rules) for c in checks)]), by=("doc_id", "check_id"))
    return rows.select("doc_id", "check_id", "seq", F.col("start").alias("pos"), "kind", "found", "correct", "snippet", F.coalesce("detail", F.lit("")).alias("detail"))


def run(check: Check, docs: DataFrame) -> DataFrame:
    """findings() of one check."""
    return findings(docs, check.check_id)


def between(sep: str) -> Callable[[Column], Column]:
    return lambda s: F.concat(s["g1"], F.lit(sep), s["g2"])


def without_citations(text: Column) -> Column:
    """DOI paths and short bracketed runs blanked; offsets hold."""
    return blank(blank(text, pattern(DOI_PATH, "i")), pattern(BRACKETS))


def collapsed(text: Column) -> Column:
    return F.regexp_replace(text, pattern(BRACKETS), " ")


def dash_rules(hyphen: str) -> tuple[Rule, ...]:
    return (
        Rule(pattern(hyphen), between(DASH), lambda s: F.concat(F.lit("use en-dash for range: "), s["found"])),
        Rule(pattern(r"(\d)\s*--\s*(\d)"), between(DASH), lambda s: F.concat(F.lit("use en-dash instead of double hyphen: "), s["found"])),
    )


def bucket(s: Column) -> Column:
    return F.floor(s["start"] / 150).cast("string")


def typed(p: str, kind: str) -> Rule:
    return Rule(pattern(p), kind=kind, key=lambda s: F.concat(F.lit(kind + ":"), bucket(s)), detail=lambda s: F.lit(kind.replace("_", " ")))


NUMBER = r"\b(\d+(?:\.\d+)?)"
CHECKS = {
    c.check_id: c
    for c in (
        Check("typo_en_dash", dash_rules(r"(?<!\w|[-–])(\d+)-(\d+)(?!\w|\.\d|[-–/])"), without_citations, 30),
        Check("typo_number_unit", (Rule(pattern(rf"{NUMBER}({TYPOGRAPHY_UNITS})(?![a-zA-Z0-9])"), between(" "), lambda s: F.concat(F.lit("add space between number and unit: "), s["found"])),), None, 30),
        Check("typo_percent_degree", (Rule(pattern(rf"{NUMBER}(%)(?=[A-Za-z])"), detail=lambda s: F.lit("percent sign directly followed by a letter")), Rule(pattern(r"\b(\d+°)(?![CFK\s°\d])"), detail=lambda s: F.lit("degree sign without unit"))), None, 30),
        Check("en_dash_ranges", dash_rules(r"(?<!\w)(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)(?!\w)"), without_citations),
        Check("nonbreaking_space_units", (Rule(pattern(rf"{NUMBER}({GRAMMAR_UNITS})(?![a-zA-Z0-9])"), between(" "), lambda s: F.concat(F.lit("no space between number and unit: "), s["found"])),)),
        Check("no_space_percent_degree", tuple(Rule(pattern(rf"{NUMBER}\s+({p})"), between(""), lambda s: F.concat(F.lit("remove space: "), s["found"])) for p in ("%", "°(?:[CFK]?)"))),
        # Positions and found are of the text with bracketed runs collapsed; the snippet is cut at these offsets from the original.
        Check("double_spaces", (Rule(pattern(r"(?<=[^\n\r\t ]) {4,}(?=[^\n\r\t ])"), found=lambda s: F.concat((s["end"] - s["start"]).cast("string"), F.lit(" consecutive space(s)"))),), collapsed, dedupe=False),
        Check("punctuation_spacing", (typed(r"(?<=[a-zA-Z0-9]) +[,;]", "space_before_comma"), typed(r",(?=[a-zA-Z][a-z]{1,})", "no_space_after_comma"), typed(r"(?<=[,\.;]) {2,}(?=[A-Za-z])", "multiple_spaces_after_punct"))),
    )
}


def multi_space(docs: DataFrame) -> DataFrame:
    """Runs of four or more spaces within a line."""
    return findings(docs, "double_spaces")


def quote_hits(text: Column) -> Column:
    straight, double, single = text.contains('"'), text.rlike("[“”]"), text.rlike("[‘’]")
    kind = F.when(straight & double, "mixed_double_quotes").when(single & straight & ~double, "mixed_single_and_straight_double")
    return let(kind, lambda k: F.when(k.isNotNull(), F.array(hit(check_id="quote_style_consistency", k=0, start=0, key="", kind=k))))


def quote_style(docs: DataFrame) -> DataFrame:
    """At most one row: straight with curly double quotes, or straight double with curly single ones."""
    return findings(docs, "quote_style_consistency").select("doc_id", "check_id", "kind")


def spelling_hits(text: Column) -> Column:
    """Pairs of which both forms occur, in the pairs' order. Words are looked up in the text's own distinct words, so it is split once however many pairs there are."""
    every = F.array(*(F.lit(w) for pair in SPELLINGS for w in pair))
    own = F.array_intersect(F.split(F.lower(text), r"(?U)\W+"), every)  # by hashing; few are left to look among
    pairs = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(a).alias("american"), F.lit(b).alias("british")) for i, (a, b) in enumerate(SPELLINGS)))

    def first(word: Column) -> Column:
        start = F.length(F.element_at(F.split(text, F.concat(F.lit(r"(?Uid)\b"), word, F.lit(r"\b")), 2), 1))
        return let(start, lambda s: snippet(text, s, s + F.length(word), 35))

    def row(p: Column) -> Column:
        return hit(check_id="english_spelling_consistency", k=0, start=p["at"], key=p["american"], found=p["american"], correct=p["british"], snippet=first(p["american"]), detail=first(p["british"]))

    both = let(own, lambda o: F.when(F.size(o) > 1, F.filter(pairs, lambda p: F.array_contains(o, p["american"]) & F.array_contains(o, p["british"]))))
    return F.transform(both, row)


def spelling(docs: DataFrame) -> DataFrame:
    """Pairs of which both forms occur: doc_id, check_id, seq (in the pairs' order), american, british, am_snippet, br_snippet; CAP pairs at most."""
    names = {"found": "american", "correct": "british", "snippet": "am_snippet", "detail": "br_snippet"}
    return findings(docs, "english_spelling_consistency").select("doc_id", "check_id", "seq", *(F.col(a).alias(b) for a, b in names.items()))


def initials_match(before: Column, acronym: Column) -> Column:
    """Whether the upper-cased initials of some run of words near the end of before spell the acronym."""
    parts = F.flatten(F.transform(F.filter(F.split(before, r"(?U)\s+"), lambda w: w != ""), lambda w: F.split(w, "-")))
    clean = F.filter(F.transform(parts, lambda w: F.regexp_replace(w, r"""^[.,;:"'()]+|[.,;:"'()]+$""", "")), lambda w: w.rlike(r"^\p{L}"))
    tail = let(clean, lambda c: F.slice(c, F.greatest(F.size(c) - (F.length(acronym) + 15) + 1, F.lit(1)), F.length(acronym) + 15))
    return F.contains(F.array_join(F.transform(tail, lambda w: F.upper(F.substring(w, 1, 1))), ""), acronym)


#: An acronym that isn't within parentheses of its own.
ACRONYM_USE = r"(?:(?<!\()\b[A-Z]{3,}\b|(?<=\()\b[A-Z]{3,}\b(?!\)))"
NAMED = "array<struct<name:string,at:int,end:int>>"


def acronym_hits(text: Column) -> Column:
    """One hit for each acronym whose first use has no definition before it: "(ABC)" after words whose initials spell it, or "ABC (some words)"."""
    skip = F.array(*map(F.lit, SKIP_ACRONYMS))

    def named(p: str, name) -> Column:
        every = F.transform(spans(text, pattern(p)), lambda s: F.struct(name(s["found"]).alias("name"), s["start"].alias("at"), s["end"].alias("end")))
        return F.filter(every, lambda x: ~F.array_contains(skip, x["name"]))

    uses = named(ACRONYM_USE, lambda f: f)
    around_ = F.filter(named(r"\([A-Z]{3,}\)", lambda f: F.substring(f, F.lit(2), F.length(f) - 2)), lambda p: initials_match(F.substring(text, F.greatest(p["at"] - 600, F.lit(0)) + 1, F.least(p["at"], F.lit(600))), p["name"]))
    after = named(r"\b[A-Z]{3,}\s+\([a-zA-Z][a-zA-Z0-9\s\-,./']{3,80}\)", lambda f: F.regexp_extract(f, "^[A-Z]+", 0))

    def judged(both: Column) -> Column:
        used, defined = both["used"], both["defined"]

        def first(name: Column) -> Column:
            at = F.array_min(F.transform(F.filter(defined, lambda d: d["name"] == name), lambda d: d["at"]))
            use = F.element_at(F.filter(used, lambda u: u["name"] == name), 1)
            return F.struct(use.alias("use"), at.alias("defined"))

        firsts = F.transform(F.array_distinct(F.transform(used, lambda u: u["name"])), first)
        bad = F.filter(firsts, lambda x: x["defined"].isNull() | (x["defined"] > x["use"]["at"]))
        return F.transform(bad, lambda x: hit(check_id="acronym_definition", k=0, start=x["use"]["at"], key=x["use"]["name"], found=x["use"]["name"], kind=F.when(x["defined"].isNull(), "never_defined").otherwise("used_before"), snippet=snippet(text, x["use"]["at"], x["use"]["end"], 35)))

    both = let(uses, lambda u: F.when(F.size(u) > 0, F.struct(u.alias("used"), F.concat(around_, after).cast(NAMED).alias("defined"))))
    return F.when(text.rlike("[A-Z]{3}"), let(both, judged))


def acronyms(docs: DataFrame) -> DataFrame:
    """Acronyms first used before any definition: doc_id, check_id, seq, pos, found, kind (never_defined or used_before), snippet. Acronyms only seen in parentheses of their own have no use."""
    return findings(docs, "acronym_definition").select("doc_id", "check_id", "seq", "pos", "found", "kind", "snippet")


#: Checks that look at a text as a whole: arrays of hits.
WHOLE = {"acronym_definition": acronym_hits, "quote_style_consistency": quote_hits, "english_spelling_consistency": spelling_hits}
