"""Compositions of operators: whole pipelines, and the catalogue of queries over the supplied tables."""
