"""Operators of the source-analysis engine."""
