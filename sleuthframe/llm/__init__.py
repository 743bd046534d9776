"""Operators for large text corpora: toxicity, decontamination, private data,
near-duplicate joins, nearest neighbours, HTML, tokens, mixing and archives."""
