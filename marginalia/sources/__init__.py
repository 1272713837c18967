"""Scans: files and their formats, repositories, book catalogs, configuration."""
