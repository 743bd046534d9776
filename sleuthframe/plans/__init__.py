"""Plans of the source-analysis engine."""
