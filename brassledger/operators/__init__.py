"""Joins, aggregations, windows and scored decisions over ledger tables."""
