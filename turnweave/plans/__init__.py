"""Queries over the sample tables, with the SQL that says the same."""
