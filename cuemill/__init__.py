"""Timed-text analytics on PySpark."""
