"""Operators of a training-data pipeline: deduplication, tokens, language, packing, sharding, search.

Nothing outside this subpackage imports it.  ``queries.py`` registers one query
per operator; each operator module has a general interface of its own.
"""
