"""The reference operators' queries; importing the modules registers them."""

from proofbase.plans import engine, relations, scalars, state, temporal  # noqa: F401
from proofbase.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
