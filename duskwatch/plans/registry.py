"""Importing this module registers every query."""

from duskwatch.plans import (  # noqa: F401
    correlation_queries,
    incident_queries,
    sensor_queries,
    response_queries,
    knowledge_queries,
    model_queries,
    stream_queries,
)
from duskwatch.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
