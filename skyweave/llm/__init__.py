"""Operators for building training corpora at scale.

Nothing else in the library imports this subpackage, so it can be removed on
its own.  Every operator takes and returns DataFrames; ``queries`` holds the
registered queries and their SQL.
"""
