"""Queries over the given tables, one per operator, each with the SQL that has to agree."""

from . import catalogue, matching, reading, reporting, spatial, stored
from . import surface  # after the queries whose rows it gives
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "catalogue", "matching", "reading", "reporting", "spatial", "stored", "surface"]
