"""Thin registered queries, each with its oracle."""
