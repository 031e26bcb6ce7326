"""Every query of the engine: importing the modules registers them."""

from tessera.plans import factor_queries, file_queries, queries
from tessera.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "factor_queries", "file_queries", "queries"]
