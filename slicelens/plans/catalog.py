"""All registered queries; importing the modules registers them."""

from __future__ import annotations

from slicelens.plans import (  # noqa: F401
    metric_queries,
    model_queries,
    packet_queries,
    sample_queries,
    source_queries,
    stream_queries,
)
from slicelens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
