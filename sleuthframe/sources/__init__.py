"""Sources of the source-analysis engine."""
