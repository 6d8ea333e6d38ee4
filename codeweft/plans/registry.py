"""All queries of the core and their SQL."""

from __future__ import annotations

from codeweft.plans import code_queries, graph_queries, text_queries, tool_queries

_PARTS = (code_queries, graph_queries, text_queries, tool_queries)

QUERIES = {k: f for m in _PARTS for k, f in m.QUERIES.items()}
SQL = {k: s for m in _PARTS for k, s in m.SQL.items()}
