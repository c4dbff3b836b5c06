"""Queries over the given tables, each with the SQL it must agree with."""

from tablehaul.plans import catalogues, files, matching, memory, profiling, transforms, validation
from tablehaul.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "catalogues", "files", "matching", "memory", "profiling", "transforms", "validation"]
