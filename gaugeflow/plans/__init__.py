"""Registered queries: gauge views over the given tables, operators on them, and their SQL twins."""
