"""Operators on text corpora and embeddings. Nothing else in the library imports this package."""
