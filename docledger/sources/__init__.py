"""Readers with fixed schemas and the writers that publish results."""
