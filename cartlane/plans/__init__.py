"""Query catalog, DuckDB oracle SQL and plan-inspection helpers."""
