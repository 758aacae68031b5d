"""Operators for large text corpora used to train language models.

Nothing else in the library imports this subpackage.
"""
