"""Operators for training-data pipelines over documents, vectors and conversations.

Nothing else in the package imports this one.
"""
