"""Corpus operators for training-data pipelines.

Ten operators over a ``documents``-like table (and ``pages`` / ``benchmark``),
each in a module of its own; ``queries`` holds the thin registered queries.
Nothing outside this subpackage imports it.
"""
