"""Bank-ledger analytics as Spark jobs.

``sources`` read raw files into tables, ``functions`` are column expressions,
``operators`` are joins, aggregations, windows and scored decisions over
DataFrames, ``plans`` combine them into whole jobs, and ``streaming`` runs them
continuously. ``llm`` holds operators for training-data pipelines; it stands
alone.
"""
