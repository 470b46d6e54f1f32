"""Operators put together: the panel, the cleaned table, the feature table."""
