"""The registry of queries: name -> DataFrame program, and DuckDB SQL for the same rows."""

from __future__ import annotations

from quarry.plans import analysis_queries, graph_queries, join_queries, retrieval_queries, search_queries, source_queries, stream_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (analysis_queries, graph_queries, join_queries, retrieval_queries, search_queries, source_queries, stream_queries):
    QUERIES |= _m.R.queries
    ORACLES |= _m.R.oracles
