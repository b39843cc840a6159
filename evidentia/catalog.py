"""All queries of this library over the test tables, with their SQL counterparts."""

from __future__ import annotations

from evidentia.plans import event_queries, graph_queries, kernel_queries, measure_queries, planning_queries, series_queries, source_queries, station_queries, table_queries

_MODULES = (event_queries, table_queries, planning_queries, station_queries, kernel_queries, series_queries, graph_queries, measure_queries, source_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
