"""Operators and queries for preparing language-model training data at scale.

Nothing else in the library imports this subpackage; it may use the library's general helpers.
"""
