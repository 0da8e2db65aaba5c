"""Importing this module registers every query."""

from episcope.plans import (  # noqa: F401
    episode_queries,
    expectation_queries,
    frame_queries,
    pose_queries,
    source_queries,
    statistics_queries,
    streaming_queries,
    temporal_queries,
)
from episcope.plans.registry import QUERIES

__all__ = ["QUERIES"]
