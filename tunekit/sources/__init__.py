"""Readers and writers for datasets and documents."""
