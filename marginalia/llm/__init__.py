"""Training-data operators: scans, deduplication, scoring and mixing of a document corpus.

Nothing outside this subpackage imports it. Every operator takes a DataFrame of
documents, touches only the id and text columns it is told about, and returns a
lazily evaluated DataFrame.
"""
