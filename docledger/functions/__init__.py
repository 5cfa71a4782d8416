"""Column expressions: text normalisation, skew-safe windows, exact quantities."""
