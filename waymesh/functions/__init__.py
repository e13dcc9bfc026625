"""Column expressions and a few Arrow-batched functions."""
