"""Operators for large-scale training-data pipelines, one module each.

Nothing outside this package imports it. ``queries.py`` holds the thin
``opN_<name>`` queries and their SQL.
"""
