"""Functions of the source-analysis engine."""
