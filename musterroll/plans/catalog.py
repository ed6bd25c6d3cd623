"""All registered queries and their oracles."""

from __future__ import annotations

from musterroll.plans import documents, histories, relations, rollups, selections  # noqa: F401
from musterroll.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
