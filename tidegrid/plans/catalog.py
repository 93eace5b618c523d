"""Importing this module registers every query."""

from __future__ import annotations

from tidegrid.plans import (  # noqa: F401
    q_attribution,
    q_compose,
    q_eval,
    q_features,
    q_frames,
    q_impute,
    q_intervals,
    q_sources,
    q_stats,
)
from tidegrid.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
