"""Column-level functions: text, array, HTML and JSON helpers."""
