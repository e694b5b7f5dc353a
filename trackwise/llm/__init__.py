"""Operators for large-scale text corpora."""
