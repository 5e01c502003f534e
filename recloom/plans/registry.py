"""All queries of the library proper."""

from recloom.plans import behaviour, catalog, encoding, events, qc, signal, sources, tables  # noqa: F401  they register on import
from recloom.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
