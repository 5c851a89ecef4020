"""Operators of a training-data pipeline over `documents` and `embeddings`.

Nothing outside this subpackage imports it.
"""
