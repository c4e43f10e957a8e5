"""Schemas, payload parsing, and reading and writing of the tables."""
