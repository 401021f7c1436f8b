"""Expressions, selections, join specifications and how they become Spark plans."""
