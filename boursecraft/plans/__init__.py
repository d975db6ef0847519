"""Registered queries over the test tables, each with its SQL twin where SQL can state it."""

from boursecraft.plans import (  # noqa: F401  (imported for their registrations)
    q_reconcile,
    q_explore,
    q_functions,
    q_scoring,
    q_series,
    q_sources,
    q_statements,
    q_tables,
)
from boursecraft.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
