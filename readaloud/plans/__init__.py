"""Registered queries and their DuckDB restatements."""
