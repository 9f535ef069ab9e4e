"""Operators from DataFrame to DataFrame, keyed by ``map_id``; none collects rows to the driver."""
