"""An extra beyond the reference: stateless scans over streams, and duplicates dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import pii, search


def pii_stream(docs: DataFrame) -> DataFrame:
    """Findings of a stream of docs(doc_id, text); append mode, no state."""
    return pii.scan(docs)


def rule_stream(lines: DataFrame) -> DataFrame:
    """Rule findings of a stream of source_line; append mode, no state."""
    return search.scan_rules(lines)


def distinct_findings(findings: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """A finding once for its keys, with state for as long as rows may be late."""
    return findings.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
