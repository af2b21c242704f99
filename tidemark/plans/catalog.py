"""All registered queries."""

from __future__ import annotations

from tidemark.plans import catalog_bars, catalog_daily, catalog_evidence, catalog_live, catalog_research, catalog_scalars, catalog_store  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
