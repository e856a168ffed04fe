"""Operators of a training-data pipeline: deduplication, language, search, scoring, privacy, packing, encoding, filters."""
