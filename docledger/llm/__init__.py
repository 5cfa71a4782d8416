"""Operators of a training-data pipeline over documents: deduplication, scans, language, tokens, shards."""
