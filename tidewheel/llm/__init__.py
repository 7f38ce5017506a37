"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing outside this subpackage imports it.  ``registry`` names the queries and
their oracle SQL; every module holds one operator with its own interface.
"""
