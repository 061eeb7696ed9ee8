"""Grounded-retrieval jobs on Spark: ingest, index, search, verify and evaluate as DataFrame transformations."""
