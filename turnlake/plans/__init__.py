"""Whole pipelines and report queries, composed from the operators."""
