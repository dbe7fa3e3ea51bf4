"""Queries over the benchmark tables, each with an independent SQL statement of the same result."""
