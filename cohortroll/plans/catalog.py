"""All registered queries."""

from cohortroll.plans.registry import ORACLE, QUERIES
from cohortroll.plans import (  # noqa: F401  (importing registers the queries)
    q_intake,
    q_contracts_joins,
    q_rollups,
    q_sampling,
    q_models,
    q_expression,
    q_prediction,
    q_representation,
    q_review,
    q_gates,
)

__all__ = ["ORACLE", "QUERIES"]
