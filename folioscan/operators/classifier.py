"""Citation style of a reference string: filters that rule styles out, weighted rules, a margin for confidence.

Rules are data. A condition is a pattern, or a combination of conditions, that compiles to one Column; scoring a reference
is one projection without any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions.text import let, pattern

STYLES = ("IEEE", "APA", "MLA", "Harvard", "Vancouver")


@dataclass(frozen=True)
class Match:
    pattern: str
    flags: str = ""

    def column(self, t: Column) -> Column:
        return t.rlike(pattern(self.pattern, self.flags))

    def sql(self, t: str) -> str:
        p = f"(?{self.flags}){self.pattern}" if self.flags else self.pattern
        return f"regexp_matches({t}, '{p.replace(chr(39), chr(39) * 2)}')"


@dataclass(frozen=True)
class Not:
    of: object

    def column(self, t: Column) -> Column:
        return ~self.of.column(t)

    def sql(self, t: str) -> str:
        return f"not ({self.of.sql(t)})"


@dataclass(frozen=True)
class All:
    of: tuple

    def column(self, t: Column) -> Column:
        out = self.of[0].column(t)
        for c in self.of[1:]:
            out = out & c.column(t)
        return out

    def sql(self, t: str) -> str:
        return " and ".join(f"({c.sql(t)})" for c in self.of)


@dataclass(frozen=True)
class Made:
    """A condition that isn't a pattern, in both languages."""

    make: object
    text: str

    def column(self, t: Column) -> Column:
        return self.make(t)

    def sql(self, t: str) -> str:
        return self.text.replace("$t", t)


def group(t: Column, p: str, i: int = 1) -> Column:
    return F.regexp_extract(t, pattern(p), i)


def few_capitals(t: Column) -> Column:
    """The title after a year has more than 4 words, at most 2 of them after the first capitalised but not all capitals."""
    words = F.filter(F.split(group(t, SENTENCE), r"(?U)\s+"), lambda w: w != "")
    return let(words, lambda w: (F.size(w) > 4) & (F.size(F.filter(F.slice(w, 2, 1000), lambda x: x.rlike(r"^\p{Lu}") & ~(x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}")))) <= 2))


def late_year(t: Column) -> Column:
    return F.length(F.element_at(F.split(t, pattern(r"\b(?:19|20)\d{2}\b"), 2), 1)) / F.length(t) > 0.45


def early_bare_year(t: Column) -> Column:
    """A year in parentheses within the first 45 %, with no comma before it."""
    return let(F.element_at(F.split(t, r"\(\d{4}\)", 2), 1), lambda before: ~F.contains(before, F.lit(",")) & (F.length(before) < F.length(t) * 0.45))


# Fixed values.
SENTENCE = r"\(?\d{4}\)?\.?\s+([A-Z][^.!?]{20,}?)[.\n]"
# Fixed values.
JOURNAL = r",\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){2,}),\s+\d+"
FIRST_NAME = r"^.{1,30},\s+(\S+)"
BRACKET, NO_BRACKET = Match(r"^\[\d+\]"), Not(Match(r"^\[\d+\]"))
VOL, NO, QUOTED5 = Match(r"\bvol\.\s*\d+", "i"), Match(r"\bno\.\s*\d+", "i"), Match(r'"[^"]{5,}"')
AVAILABLE = Match(r"Available (?:at|from):", "i")
WEB_QUOTE = All((QUOTED5, Match(r"https?://|www\."), Match(r"\b(?:Accessed|Retrieved)\b", "i"), NO_BRACKET, Not(AVAILABLE)))
STANDARD = Match(r"(?:\b(?:ISO|IEC|ANSI(?:/\w+)?|AS/NZS|NZS|ASTM|IETF|RFC)\b[\s/\w.\-]*\d{4,}|\b(?:W3C|WCAG|IEEE\s+\d{3})\b)", "i")
YEAR_PARENS = Match(r"\(\d{4}\)")
# Fixed values.
UNINVERTED = r'^([A-Z][\w\-]+)(?:\s+[A-Z]\.?)?\s+([A-Z][\w\-]+)\.\s*("|\b[A-Z])'

#: Fixed values: (condition, styles that stay). Filters intersect; if none is left, all are.
FILTERS = (
    (BRACKET, ("IEEE", "Vancouver")),
    (Match(r"\d{4};\d+\(\d+\):\d+"), ("Vancouver",)),
    (Match(r"https://doi\.org/10\.\d{4}"), ("APA",)),
    (Match(r"\[cited\s+\d{4}\b", "i"), ("Vancouver",)),
    (Match(r"\[Internet\]", "i"), ("Vancouver",)),
    (Match(r"[A-Za-z]\s*;\s*\d{4}[.\s]"), ("Vancouver",)),
    (Match(r"\b[A-Z][a-z]+\s+[A-Z]{2,4},\s+[A-Z][a-z]+\s+[A-Z]{1,4}[,.]"), ("Vancouver",)),
    (Match(r"\bRetrieved\b.{0,30}\bfrom\b", "i"), ("APA",)),
    (Match(r"^\d+\.\s+[A-Z]"), ("Vancouver",)),
    (All((Match(r"^[A-Z][a-z]+,\s+[A-Z][a-z]{2,}"), NO_BRACKET)), ("IEEE", "APA", "MLA", "Harvard")),
    (Match(r"&\s+[A-Z][a-z]+,\s+[A-Z]\."), ("APA",)),
    (All((QUOTED5, VOL, NO)), ("MLA",)),
    (All((NO_BRACKET, Match(UNINVERTED))), ("MLA",)),
    (WEB_QUOTE, ("MLA",)),
    (All((Match(r"^[A-Z][a-z]+,\s+[A-Z]\.\.\s"), Match(r"\bPatent\b", "i"))), ("MLA",)),
    (All((STANDARD, NO_BRACKET)), ("APA", "MLA", "Harvard", "Vancouver")),
    (All((NO_BRACKET, YEAR_PARENS, Made(early_bare_year, r"not contains(regexp_split_to_array($t, '\(\d{4}\)')[1], ',') and length(regexp_split_to_array($t, '\(\d{4}\)')[1]) < length($t) * 0.45"), Not(Match(r"\(\d{4}\)\.\s+[A-Z]")))), ("Harvard",)),
)
# Fixed values.
MEDIUM = r"\[(?:Internet|vle online|serial online|dissertation on the Internet|monograph on the Internet|homepage on the Internet|serial on the Internet)\]"
#: Fixed values: (style, weight, condition).
RULES = (
    ("IEEE", 10.0, BRACKET),
    ("IEEE", 6.0, Match(r'"[^"]{10,}"')),
    ("IEEE", 1.5, Match(r"\b[A-Z][a-z]+\.\s+[A-Z]")),
    ("IEEE", 4.0, Match(r"\b(?:IEEE|Trans\.|Proc\.|Conf\.|Lett\.|Mag\.)\b")),
    ("IEEE", 5.0, Match(r"\[\d+,\s*pp?\.\s*\d+")),
    ("IEEE", 2.0, Match(r"(?:[A-Z]\.\s*){2,}.*et al\.", "i")),
    ("IEEE", 2.0, Match(r"\bdoi:\s*10\.\d{4}", "i")),
    ("APA", 8.0, Match(r"[A-Z][a-z]+,\s+[A-Z]\.\s*[A-Z]?\.\s*[\(&]?\s*\(?\d{4}\)?")),
    ("APA", 6.0, Match(r"&\s+[A-Z][a-z]+,\s+[A-Z]\.")),
    ("APA", 7.0, Match(r"https://doi\.org/10\.\d{4}")),
    ("APA", 4.0, All((Match(SENTENCE), Made(few_capitals, rf"len(string_split(trim(regexp_extract($t, '{SENTENCE}', 1)), ' ')) > 4 and len(list_filter(string_split(trim(regexp_extract($t, '{SENTENCE}', 1)), ' ')[2:], lambda w: regexp_matches(w, '^\p{{Lu}}') and not (regexp_matches(w, '\p{{Lu}}') and not regexp_matches(w, '\p{{Ll}}')))) <= 2")))),
    ("APA", 7.0, Match(r"\bRetrieved\b.{0,30}\bfrom\b", "i")),
    ("APA", 7.0, Match(r"\bAccessed\b.{0,30}\bfrom\b", "i")),
    ("APA", 8.0, Match(r"\[(?:Map|Image|Photograph|Video|Film|Illustration)\]\.\s*\(\d{4}\)", "i")),
    ("APA", 5.0, Match(r"\(\d{4}\)\.\s+[A-Z]")),
    ("APA", 6.0, Match(r"\(\w+\.?\s+\d+,\s+\d{4}\)")),
    ("APA", 5.0, Match(r"\(pp\.\s*\d+")),
    ("MLA", 7.0, Made(lambda t: let(F.regexp_replace(group(t, FIRST_NAME), r"\.+$", ""), lambda w: (F.length(w) >= 3) & ~w.rlike("^[A-Z]{1,2}$")), rf"length(regexp_replace(regexp_extract($t, '{FIRST_NAME}', 1), '\.+$', '')) >= 3")),
    ("MLA", 7.0, All((VOL, NO))),
    ("MLA", 9.0, Match(r"YouTube,\s*(?:uploaded by|dir\.)", "i")),
    ("MLA", 4.0, All((QUOTED5, Match(r"\bAccessed\b"), NO_BRACKET, Not(AVAILABLE)))),
    ("MLA", 6.0, Match(r"\bAccessed\b")),
    ("MLA", 4.0, Match(r"[A-Z][a-zA-Z\s]+,\s+vol\.\s*\d+", "i")),
    ("MLA", 5.0, Match(r"\b(?:Print|Web)\s*\.$")),
    ("MLA", 3.0, All((Match(r"\b(?:19|20)\d{2}\b"), Match(r"^[A-Z][a-z]+,\s+[A-Z][a-z]+\s*\."), Made(late_year, r"length(regexp_split_to_array($t, '\b(?:19|20)\d{2}\b')[1]) / length($t) > 0.45")))),
    ("Harvard", 5.0, Match(r"^[A-Z][a-z]+,\s+[A-Z]{2,}")),
    ("Harvard", 2.0, All((Match(r"\w[\w\-]+,\s+\w[\.\s]*\(?\d{4}\)?"), Match(r"\(\d{4}\)\.")))),
    ("Harvard", 7.0, All((Match(r"\w[\w\-]+,\s+\w[\.\s]*\(?\d{4}\)?"), Not(Match(r"\(\d{4}\)\."))))),
    ("Harvard", 7.0, Match(r"\w[\w\-]+,\s+\w\.?\s+et al[.,]?\s+\(\d{4}\)", "i")),
    ("Harvard", 7.0, Match(r"\w[\w\-]+,\s+\w\.?\s+et al\s+\(\d{4}\)", "i")),
    ("Harvard", 6.0, Match(r"^[A-Z][a-zA-Z\s\-\.]+\s+\(\d{4}\)\s+[A-Z]")),
    ("Harvard", 6.0, Match(r"\d{4}:\s*\d+")),
    ("Harvard", 4.0, Match(r"[A-Z][a-z]+:\s+[A-Z][a-zA-Z\s]+(?:Press|Publishing|Publishers|Books|Ltd|Inc)")),
    ("Harvard", 8.0, AVAILABLE),
    ("Harvard", 4.0, Match(r"Available (?:at|from):.+\(Accessed", "is")),
    ("Harvard", 3.0, Match(JOURNAL)),
    ("Vancouver", 8.0, Match(r"^\d+[\.\s]\s*[A-Z]")),
    ("Vancouver", 8.0, Match(r"\b[A-Z][a-z]+\s+[A-Z]{1,4},")),
    ("Vancouver", 7.0, Match(r"\b\d{3,4}[-–]\d{1,2}\b")),
    ("Vancouver", 8.0, Match(r"\b(?:N Engl J Med|J Am|Ann\s+[A-Z]|Br\s+[A-Z]|Am\s+J\s+[A-Z]|Clin\s+[A-Z]|Int\s+J\s+[A-Z])\b")),
    ("Vancouver", 10.0, Match(r"\d{4};\d+\(\d+\):\d+")),
    ("Vancouver", 5.0, Match(r"[A-Z]{1,3},\s+[A-Z]{1,3},\s+[A-Z]{1,3},\s+et al", "i")),
    ("Vancouver", 8.0, Match(MEDIUM, "i")),
    ("Vancouver", 5.0, Match(r"\b\d+\s+p\.\s*$")),
    ("Vancouver", 4.0, All((BRACKET, Match(r"\b[A-Z][a-z]+\s+[A-Z]{1,4},")))),
    ("MLA", 2.0, All((Match(r"^[A-Z][a-z]+,\s+[A-Z][a-z]+"), Not(YEAR_PARENS), NO_BRACKET))),
)
WEB_NAMES = All((WEB_QUOTE, Match(r'^[A-Z][\w\-]+(?:,\s+[A-Z]|\.\s+")')))


def classify(raw: Column) -> Column:
    """struct(style, confidence, score). Ties go to the style listed first; a best score of 0 is the only style left, or Unknown."""
    t = F.trim(raw)

    def judge(t: Column) -> Column:
        stays = []
        for s in STYLES:
            ok = F.lit(True)
            for c, keep in FILTERS:
                if s not in keep:
                    ok = ok & ~c.column(t)
            stays.append(ok)
        return F.struct(*(x.alias(s) for s, x in zip(STYLES, stays)))

    def score(t: Column, stays: Column) -> Column:
        none = F.lit(True)
        for s in STYLES:
            none = none & ~stays[s]
        standard = STANDARD.column(t)
        out = []
        for s in STYLES:
            total = F.lit(0.0)
            for style, weight, c in RULES:
                if style == s:
                    total = total + F.when(c.column(t), weight).otherwise(0.0)
            if s == "Harvard":
                total = F.when(standard, F.greatest(total - 6.0, F.lit(0.0))).otherwise(total)
            out.append(F.struct(F.lit(s).alias("style"), total.alias("score"), (none | stays[s]).alias("ok")))
        return F.filter(F.array(*out), lambda x: x["ok"])

    def settle(t: Column, some: Column) -> Column:
        zero = F.forall(some, lambda x: x["score"] == 0)
        return F.transform(some, lambda x: F.named_struct(F.lit("style"), x["style"], F.lit("score"), x["score"] + F.when((x["style"] == "MLA") & STANDARD.column(t) & zero, 1.0).otherwise(0.0) + F.when((x["style"] == "MLA") & WEB_NAMES.column(t), 7.0).otherwise(0.0)))

    def pick(some: Column) -> Column:
        best = F.array_max(F.transform(some, lambda x: x["score"]))
        name = F.element_at(F.filter(some, lambda x: x["score"] == best), 1)["style"]
        ranked = F.sort_array(F.transform(some, lambda x: x["score"]), asc=False)
        margin = best - F.coalesce(F.get(ranked, F.lit(1)), F.lit(0.0))
        confidence = F.when(best == 0, "LOW").when(margin >= 8, "HIGH").when(margin >= 4, "MEDIUM").otherwise("LOW")
        return F.struct(F.when((best == 0) & (F.size(some) > 1), "Unknown").otherwise(name).alias("style"), confidence.alias("confidence"), best.alias("score"))

    return let(t, lambda x: let(let(judge(x), lambda stays: score(x, stays)), lambda some: let(settle(x, some), pick)))


def oracle(source: str, raw: str, keys: str) -> str:
    """The same rules as DuckDB SQL over source(keys, raw)."""
    stays = [" and ".join(["true", *(f"not ({c.sql('t')})" for c, keep in FILTERS if s not in keep)]) for s in STYLES]
    score = []
    for s in STYLES:
        total = " + ".join(f"case when {c.sql('t')} then {w}::double else 0 end" for style, w, c in RULES if style == s)
        score.append(f"case when standard then greatest({total} - 6, 0) else {total} end" if s == "Harvard" else total)
    pairs = ", ".join(f"{{'i': {i}, 'style': '{s}', 'score': ({v})::double, 'ok': ({ok})}}" for i, (s, v, ok) in enumerate(zip(STYLES, score, stays)))
    return f"""a as (select {keys}, t, web, standard, [{pairs}] as l from (select {keys}, trim({raw}) as t, {WEB_NAMES.sql(f'trim({raw})')} as web, {STANDARD.sql(f'trim({raw})')} as standard from {source})),
b as (select {keys}, web, standard, case when len(list_filter(l, lambda x: x.ok)) = 0 then l else list_filter(l, lambda x: x.ok) end as l from a),
c as (select *, len(l) as n, len(list_filter(l, lambda x: x.score <> 0)) = 0 as zero, unnest(l) as x from b),
e as (select {keys}, n, x.i as i, x.style as style, x.score + case when x.style = 'MLA' and standard and zero then 1 else 0 end + case when x.style = 'MLA' and web then 7 else 0 end as score from c),
f as (select {keys}, max(n) as n, max(score) as best, list_sort(list(score), 'DESC') as s, arg_min(style, -score * 10 + i) as name from e group by {keys}),
cl as (select {keys}, case when best = 0 and n > 1 then 'Unknown' else name end as style, case when best = 0 then 'LOW' when best - coalesce(s[2], 0) >= 8 then 'HIGH' when best - coalesce(s[2], 0) >= 4 then 'MEDIUM' else 'LOW' end as confidence, best as score from f)"""
