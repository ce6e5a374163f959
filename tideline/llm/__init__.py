"""Operators of a training-data pipeline over text tables.

Nothing outside this subpackage imports it.  Each operator is a module; the
thin query that applies it to the test tables is in :mod:`tideline.llm.queries`.
"""
