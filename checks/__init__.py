"""Queries over the given tables and their plain-SQL twins."""
