"""Enumerations that several operators share."""

from __future__ import annotations

SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
SOURCE_RANK = {"hybrid": 3, "llm": 2, "static_analysis": 1}
LAYER_RANK = {"static": 2, "cross": 1, "llm": 0}
LANGUAGE_OF = {"js": "javascript", "c": "c", "h": "c", "pc": "proc", "sql": "sql", "xml": "xml"}
SECONDS_OF = {"javascript": 15, "c": 20, "proc": 25, "sql": 10, "xml": 10}
EVENTS = ("DECLARE", "OPEN", "FETCH", "CLOSE")
DML = ("SELECT", "INSERT", "UPDATE", "DELETE", "MERGE")
