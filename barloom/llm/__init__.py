"""Operators of a training-data pipeline over documents, embeddings and labels.

Nothing outside this folder imports it; the queries are in ``queries.py``.
"""
