"""Baselines: accepted findings by fingerprint, as JSON on the driver and as a table in plans."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

FILENAME, FORMAT = "scan-baseline.json", 1


def load(path: str) -> dict[str, dict]:
    """Entries by fingerprint; a file that is no baseline, or of a newer format, is an error."""
    with open(path, encoding="utf-8") as f:
        try:
            data = json.load(f)
        except ValueError as e:
            raise ValueError(f"baseline {path} is not valid JSON: {e}") from e
    if not isinstance(data, dict) or not isinstance(data.get("findings"), dict):
        raise ValueError(f'baseline {path} has no "findings" object')
    if data.get("version", FORMAT) > FORMAT:
        raise ValueError(f"baseline {path} has format {data['version']}; this version reads {FORMAT}")
    return data["findings"]


def load_if_present(path: str) -> dict[str, dict]:
    return load(path) if os.path.exists(path) else {}


def table(spark: SparkSession, entries: dict[str, dict]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in entries], "fingerprint string") if entries else spark.createDataFrame([], "fingerprint string")


def write(findings: DataFrame, path: str, note: str | None = None) -> int:
    """Writes the findings as accepted, the last of equal fingerprints; returns how many entries there are."""
    entries = {r.fingerprint: {"rule": r.rule_id, "file": r.file, "line": r.line, "snippet": r.snippet[:200]} | ({"note": note} if note else {}) for r in findings.toLocalIterator()}
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"version": FORMAT, "generatedAt": datetime.now(UTC).isoformat(), "findings": dict(sorted(entries.items()))}, f, indent=2, ensure_ascii=False)
        f.write("\n")
    return len(entries)
