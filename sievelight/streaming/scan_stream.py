"""The scan over a stream of files.  All rules are per file and keep no state, so the batch plan runs under Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.model import Rule, severity_rank
from ..plans.scan import MARKER, enrich, raw_findings


def scan_stream(files: DataFrame, rules: list[Rule] | None = None, min_severity: str = "info", boost: bool = True, marker: str = MARKER) -> DataFrame:
    """Findings (unordered) of a streaming ``files(path, text)``, for append-mode sinks."""
    rows = enrich(raw_findings(files, rules), rules, boost, marker)
    return rows.where(~F.col("ignored") & (F.col("rank") >= severity_rank(min_severity))).drop("ignored")
