"""Operators for preparing training corpora.

Nothing outside this subpackage imports it. ``queries.py`` registers one query
per operator; each operator module documents what it returns for nulls, empty
texts, ties, repeated rows and empty tables.
"""
