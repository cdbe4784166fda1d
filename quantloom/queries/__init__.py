"""All queries of the engine and their SQL twins."""

from quantloom.queries import expressions, ingest, market, more
from quantloom.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "expressions", "ingest", "market", "more"]
