"""Structured Streaming versions of the incremental operators."""
