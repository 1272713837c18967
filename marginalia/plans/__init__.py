"""Composed plans, the tools over them, and the registry of queries."""
