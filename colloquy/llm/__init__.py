"""Operators of a training-data pipeline over whole document corpora.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
contract queries, the other modules the operators themselves.
"""
