"""Equivalent SQL of the registered queries, for cross-checking in another engine."""
