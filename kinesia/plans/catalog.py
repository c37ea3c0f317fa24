"""Imports every query module, so that the registry is complete."""

from __future__ import annotations

from kinesia.plans import q_align, q_delivery, q_explore, q_gesture, q_legacy, q_quality  # noqa: F401
from kinesia.plans.registry import ORACLES, QUERIES

FLAGSHIP = "seq_summary"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
