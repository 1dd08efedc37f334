"""Queries over the test tables, each with SQL where SQL can express it."""
