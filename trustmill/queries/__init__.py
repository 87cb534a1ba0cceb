"""Registered queries: one or more for each operator, with SQL for a second engine."""

from __future__ import annotations

from . import facts, quality, texts, trusted
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "facts", "quality", "texts", "trusted"]
