"""The registry of the engine's queries and their SQL counterparts."""

from __future__ import annotations

from harvestry.plans import classify, details, evidence, extraction, health, landing, matching, orders, queues, reading, resolution, scheduling, sets, spatial, statistics, structured, textual, upkeep, urls, views, windows  # noqa: F401
from harvestry.plans.registry import ORACLES, QUERIES
from harvestry.streaming import plans as _streaming, rests as _rests  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
