"""All registered queries."""

from chronolane.plans import expression_queries, model_queries, sequence_queries, source_queries, table_queries  # noqa: F401
from chronolane.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
