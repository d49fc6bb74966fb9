"""Readers of documents and derived tables."""
