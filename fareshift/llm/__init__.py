"""Operators of a training-data pipeline: language, quality, duplicates, leaks,
tokens, shards, language-model scores, secrets and vector search.

Nothing else in the library imports this subpackage.
"""
