"""Column functions: every one takes and returns columns, so Catalyst sees plain expressions."""
