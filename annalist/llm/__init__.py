"""Training-data operators: filtering, scoring, deduplication, formatting and packing.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries.py`` binds them to the documents tables.
"""
