"""Operators of a training-data pipeline over documents, vectors and conversations."""
