"""Operators for training-data pipelines over text, embeddings, pages and urls."""
