"""The queries of the driver contract, by family."""

from vintra.queries import bitemporal, jobs, models, relational, retrieval, scoring  # noqa: F401
from vintra.queries.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
