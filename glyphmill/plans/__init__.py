"""Queries and their SQL equivalents."""
