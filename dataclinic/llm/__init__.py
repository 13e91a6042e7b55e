"""Corpus operators for training-data pipelines (dealt list, one module each).

Nothing else in the library imports this subpackage.
"""
