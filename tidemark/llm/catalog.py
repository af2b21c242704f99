"""All registered queries of the subpackage."""

from __future__ import annotations

from tidemark.llm import queries_docs, queries_text  # noqa: F401
from tidemark.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
