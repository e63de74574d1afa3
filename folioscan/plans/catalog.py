"""All queries of the library and their oracles by name."""

from __future__ import annotations

from . import analyser_queries, corpus_queries, layout_queries, numbering_queries, reference_queries, report_queries, text_queries

MODULES = (text_queries, numbering_queries, reference_queries, analyser_queries, report_queries, layout_queries, corpus_queries)
QUERIES = {name: q for m in MODULES for name, q in m.Q.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.O.items()}
