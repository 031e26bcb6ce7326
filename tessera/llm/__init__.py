"""Operators for building training data from text, pages, vectors and conversations.

Nothing else in the library imports this subpackage.
"""
