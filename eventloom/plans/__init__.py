"""The catalogue of queries: importing it registers all of them."""

from eventloom.plans import conforming, parsing, publishing, resolving, selecting  # noqa: F401
from eventloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
