"""Builders of DuckDB SQL for the oracles: the same relations in another engine, whose patterns know no lookaround."""

from __future__ import annotations

from folioscan.sources.manuscripts import MANUSCRIPTS

HEADER = r"(?im)^\s*(?:\d+\.?\s+)?(?:references?|bibliography)\s*$"
BODY = f"m as ({MANUSCRIPTS}), d as (select doc_id, full_text, string_split_regex(full_text, '{HEADER}')[1] as body from m)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def blanked(text: str, p: str) -> str:
    """Matches of p in text as spaces of the same length."""
    return f"array_to_string(list_transform(range(1, len(string_split_regex({text}, {lit(p)})) + 1), lambda i: string_split_regex({text}, {lit(p)})[i] || coalesce(repeat(' ', length(regexp_extract_all({text}, {lit(p)})[i])), '')), '')"


def spans(source: str, text: str, p: str, k: int = 0, groups: int = 0, original: str | None = None, keep: str = "") -> str:
    """Rows (doc_id, k, s, e, found, g1, g2, bef, aft, o): matches of p in text, their 0-based places, the characters beside them, the original text."""
    g = ", ".join(f"regexp_extract_all({text}, {lit(p)}, {i if i <= groups else 0}) as g{i}" for i in (1, 2))
    keep_ = f", {keep}" if keep else ""
    return f"""select doc_id{keep_}, {k} as k, x.s as s, x.s + x.n as e, x.f as found, x.g1 as g1, x.g2 as g2, case when x.s > 0 then substr(t, x.s, 1) else '' end as bef, substr(t, x.s + x.n + 1, 1) as aft, substr(t, x.s + x.n + 1, 40) as aft40, o
  from (select doc_id{keep_}, t, o, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': (list_sum(list_transform(parts[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0))::bigint,
    'n': length(m[i]), 'f': m[i], 'g1': g1[i], 'g2': g2[i]}})) as x
  from (select doc_id{keep_}, {text} as t, {original or text} as o, regexp_extract_all({text}, {lit(p)}) as m, {g}, string_split_regex({text}, {lit(p)}) as parts from {source}) where len(m) > 0)"""


def snippet(width: int, text: str = "o", s: str = "s", e: str = "e") -> str:
    return rf"trim(regexp_replace(substr({text}, greatest({s} - {width}, 0) + 1, {e} + {width} - greatest({s} - {width}, 0)), '\s+', ' ', 'g'))"


def capped(rows: str, rules: int, cap: int = 25, key: str = "found") -> str:
    """First of each key of a document, then the cap, rule by rule, and seq."""
    counts = ", ".join(f"count(*) filter (k = {i}) over (partition by doc_id) as n{i}" for i in range(rules))
    kept, cases = "0", []
    for i in range(rules):
        allowed = f"greatest({cap} - ({kept}), 1)"
        cases.append(f"(k = {i} and rank <= {allowed})")
        kept = f"{kept} + least(n{i}, {allowed})"
    first = f"qualify row_number() over (partition by doc_id, {key} order by k, s) = 1" if key else ""
    return f"""select *, row_number() over (partition by doc_id order by k, s) as seq from (
  select *, row_number() over (partition by doc_id, k order by s) as rank, {counts} from (select * from ({rows}) {first})) where {" or ".join(cases)}"""
