"""Registered queries and their SQL."""

from __future__ import annotations

from . import context, issues, plans, source, text
from ._base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "context", "issues", "plans", "source", "text"]
