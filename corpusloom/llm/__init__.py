"""Operators for large training-text pipelines: counting, scoring, deduplication, scanning."""
