"""The registry of queries over the tables, each with its DuckDB twin."""
