"""Importing this module registers every query."""

from shutterlake.plans import (  # noqa: F401
    alert_queries, decode_queries, device_queries, gallery_queries, labeling_queries, stats_queries,
    stream_queries,
)
from shutterlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
