"""Registered queries: every operator over the whole driver tables, with its SQL twin where SQL can say it."""

from . import aggregate_queries, embedding_queries, evaluator_queries, frame_queries  # noqa: F401
from . import job_queries, join_queries, metric_queries, scaling_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
