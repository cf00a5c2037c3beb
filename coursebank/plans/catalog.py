"""Imports every query module, which fills the registry."""

from coursebank.plans import (  # noqa: F401
    ledger_queries,
    planning_queries,
    relational_queries,
    scoring_queries,
    stream_queries,
    text_queries,
)
from coursebank.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
