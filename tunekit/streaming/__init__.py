"""Incremental versions of the document and dataset jobs."""
