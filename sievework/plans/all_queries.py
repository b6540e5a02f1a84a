"""Every query of the library."""

from sievework.plans import ranking_queries, relational_queries, storage_queries, text_queries, workflow_queries
from sievework.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "ranking_queries", "relational_queries", "storage_queries", "text_queries", "workflow_queries"]
