"""All registered queries."""

from tollgate.plans import (  # noqa: F401
    core_queries,
    model_queries,
    ops_queries,
    source_queries,
    stream_queries,
)
from tollgate.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
