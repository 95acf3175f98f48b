"""The operators as queries: importing this module fills the registry."""

from __future__ import annotations

from . import q_audit, q_models, q_pairs, q_text, q_vectors  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
