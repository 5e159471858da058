"""Streaming twins of the KPI operators."""
