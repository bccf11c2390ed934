"""The registered queries: name to Spark query, and name to DuckDB SQL with the same rows."""

from __future__ import annotations

from catchwater.plans import analysis_queries, hydro_queries, site_queries, source_queries, surface_queries

QUERIES = hydro_queries.QUERIES | source_queries.QUERIES | site_queries.QUERIES | analysis_queries.QUERIES | surface_queries.QUERIES
ORACLE_SQL = hydro_queries.ORACLE_SQL | source_queries.ORACLE_SQL | site_queries.ORACLE_SQL | analysis_queries.ORACLE_SQL | surface_queries.ORACLE_SQL
