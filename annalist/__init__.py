"""Institutional memory on Spark: ledger, passages, fact graph, retrieval and governance as DataFrames."""
