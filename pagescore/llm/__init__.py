"""Operators of a training-data pipeline, and the queries that apply them to whole tables.

Nothing outside this subpackage imports it.
"""
