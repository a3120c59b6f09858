"""Operators for preparing large text corpora as training data.

Nothing else in the library imports this subpackage.  ``registry`` holds the
queries, ``oracle`` their DuckDB SQL where SQL can express them.
"""
