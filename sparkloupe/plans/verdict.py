"""Composed plans: from text to verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SEVERITY_RANK
from ..operators import issues, one_pass, pii


def document_verdicts(docs: DataFrame) -> DataFrame:
    """Which documents must not ship: scan, drop low findings, a verdict for each row. A document's findings stay beside
    it, so there is neither a shuffle nor a join. A null text can't be analysed."""
    found = F.filter(pii.findings(F.col("text"), pii.RULES + pii.SECRETS), lambda f: f["severity"] != "low")
    rows = docs.select(F.col("doc_id").alias("file_id"), F.col("text").isNull().alias("failed"), F.transform(found, lambda f: f["severity"]).alias("found"))
    counts = {s: F.coalesce(F.size(F.filter("found", lambda x: x == s)), F.lit(0)).cast("long") for s in SEVERITY_RANK}  # noqa: B023
    rows = rows.withColumns({s: F.when(F.col("failed"), F.lit(0).cast("long")).otherwise(c) for s, c in counts.items()})
    risk = issues.verdict(F.col("critical"), F.col("high"), F.col("failed"))
    return rows.select("file_id", *SEVERITY_RANK, risk.alias("risk"), (~risk.isin("UNABLE_TO_ANALYZE", "CRITICAL")).alias("allowed"))


def embedded_sql_findings(files: DataFrame) -> DataFrame:
    """All block, cursor and file rules of embedded SQL files(file_id, content): (file_id, rule_id, severity, line_no)."""
    return one_pass.all_findings(files)
