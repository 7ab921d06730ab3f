"""Checked queries: each operator on tables derived from the test data, next to the same result in plain SQL."""
