"""Captured web pages to clean, deduplicated records, as Spark jobs."""

__version__ = "0.1.0"
