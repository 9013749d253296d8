"""Operators for training-data pipelines: documents, pages and conversations."""
