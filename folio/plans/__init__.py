"""Queries of the library's own operators on the driver's tables."""

from folio.plans import detect, evaluate, flow, service, store, text  # noqa: F401  they register their queries
from folio.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
