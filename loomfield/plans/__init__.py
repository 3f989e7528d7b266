"""Registered queries, grouped by subject."""
