"""Operators for preparing text corpora.

Every operator takes and returns DataFrames.  Nothing outside this
subpackage imports it; ``queries.py`` holds the registered queries.
"""
