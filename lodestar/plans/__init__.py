"""Registered queries: retrieval and maintenance over the test tables."""
