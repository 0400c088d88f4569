"""Whole queries: adapters of the test tables, the query catalogue with its SQL, the query service."""
