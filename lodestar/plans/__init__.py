"""Registered queries over the supplied tables, with the SQL of their results."""

from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
