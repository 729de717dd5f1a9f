"""Jobs composed from the operators, and the queries registered for checking."""

from tidegate.plans import (  # noqa: F401
    contract_queries, feature_queries, operations_queries, pipeline_queries, quality_queries,
)
from tidegate.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
