"""Recency analytics on PySpark."""
