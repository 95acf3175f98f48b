"""All registered queries: importing this module fills the registry."""

from __future__ import annotations

from . import q_explain, q_ingest, q_metrics, q_quality, q_service, q_streams  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
