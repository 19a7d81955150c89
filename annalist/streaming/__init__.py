"""Streams over the ledger: dedup, windowed metrics, current values, folds."""
