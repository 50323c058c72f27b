"""Joins, binds, grouping and pivots of frames."""
