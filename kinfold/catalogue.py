"""Registered queries of the linkage operators, and their SQL."""

from __future__ import annotations

from kinfold.plans import model_queries, queries, star_queries

QUERIES = queries.QUERIES
ORACLE = queries.ORACLE
__all__ = ["ORACLE", "QUERIES", "model_queries", "star_queries"]
