"""Queries by name and their SQL."""

from .plans import oracles, queries, round_trips

QUERIES = queries.QUERIES | round_trips.QUERIES
ORACLES = oracles.ORACLES | round_trips.ORACLES

__all__ = ["ORACLES", "QUERIES"]
