"""Queries over the provided tables and the SQL that checks them."""
