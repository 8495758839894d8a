"""All registered queries and their SQL twins."""

from __future__ import annotations

from tallyrank.plans import data_queries, graph_queries, history_queries, ranking_queries, text_queries

_MODULES = (history_queries, ranking_queries, graph_queries, text_queries, data_queries)

QUERIES = {name: fn for m in _MODULES for name, fn in m.Q.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.S.items()}
