"""DataFrame-in, DataFrame-out operators of the ledger."""
