"""Operators for training-data pipelines over ``documents`` and ``embeddings``.

Nothing else in the library imports this package. Each operator module has a
general interface; ``queries.py`` registers the thin ``opN_`` queries.
"""
