"""Registered queries, each with its DuckDB equivalent."""
