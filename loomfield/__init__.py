"""Posting analytics as Spark jobs."""
