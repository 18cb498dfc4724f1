"""Registered queries over the given tables."""
from gazeloom.plans import (  # noqa: F401
    q_sources, q_columns, q_joins, q_gaze, q_math, q_windows, q_aggregates, q_calibration, q_trials, q_reports, q_streams, q_session)
from gazeloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
