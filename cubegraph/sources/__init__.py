"""Schemas, readers, writers and the vocabulary."""
