"""Spark jobs over sparse per-cell methylation profiles."""
