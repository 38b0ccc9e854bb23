"""All registered queries."""

from siltmark.plans import queries_data, queries_metrics, queries_pipeline, queries_stream, queries_tasks  # noqa: F401
from siltmark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
