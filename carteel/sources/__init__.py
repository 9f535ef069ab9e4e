"""Readers of the file formats around a map, and writers of results; all by Spark's own readers."""
