"""Whole extraction plans, and the queries that exercise them."""
