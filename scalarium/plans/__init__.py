"""Registered queries of the library, and the SQL that says the same."""

from scalarium.plans import office_queries, structure_queries
from scalarium.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "office_queries", "structure_queries"]
