"""Accountability analytics as declarative Spark plans."""
