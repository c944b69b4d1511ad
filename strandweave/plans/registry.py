"""All registered queries of the library and their SQL."""

from . import graph_queries, more_queries  # noqa: F401
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
