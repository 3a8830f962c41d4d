"""All queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from sigloom.llm import sketch_queries, text_queries

_MODULES = (sketch_queries, text_queries)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
