"""Equivalent ANSI SQL for DuckDB, assembled from named common table expressions."""
