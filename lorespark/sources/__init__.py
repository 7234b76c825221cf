"""Readers and writers beyond Spark's own formats."""
