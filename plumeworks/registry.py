"""All queries of the engine and their SQL oracles."""

from __future__ import annotations

from .plans import dashboard, evaluation, history, ingest, rules, storage, streaming, tracking  # noqa: F401  (they register their queries)
from .plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
