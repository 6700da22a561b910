"""Report formats.  Line formats are DataFrames; documents (JSON, SARIF, human) are put together from ordered rows on the driver, for terminals;
:mod:`..sinks.documents` writes JSON and SARIF of any size."""

from __future__ import annotations

import json
import os
import re
import sys
import textwrap
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import constants
from ..operators.detectors import RULES
from ..operators.model import SEVERITIES, Rule
from .scan import FINDING, Scan

TOOL, VERSION = "sievelight", "0.1.0"
# SARIF levels and scores, workflow commands, terminal colours.
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SARIF_SCORE = {"critical": "9.5", "high": "8", "medium": "5", "low": "3", "info": "1"}
COMMAND = {"critical": "error", "high": "error", "medium": "warning", "low": "notice", "info": "notice"}
COLORS = {"critical": "91;1", "high": "31", "medium": "33", "low": "34", "info": "90"}


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings by severity, zero where there is none."""
    spark = findings.sparkSession
    every = spark.range(len(SEVERITIES)).select(F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (F.col("id") + 1).cast("int")).alias("severity"))
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return every.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("findings"))


def _data(text: Column) -> Column:
    for raw, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def _property(text: Column) -> Column:
    return F.replace(F.replace(_data(text), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def github_lines(findings: DataFrame) -> DataFrame:
    """Workflow annotations, one ``line`` per finding."""
    level = F.element_at(constants(COMMAND), F.col("severity"))
    parts = [F.lit("::"), level, F.lit(" file="), _property(F.col("file")), F.lit(",line="), F.col("line").cast("string"), F.lit(",col="), F.col("column").cast("string"), F.lit(",title="), _property(F.concat(F.lit(f"{TOOL}: "), F.col("rule_title"))), F.lit("::"), _data(F.concat(F.col("message"), F.lit(" ("), F.col("rule_id"), F.lit(")")))]
    return findings.select(F.concat(*parts).alias("line"))


def compact_lines(findings: DataFrame) -> DataFrame:
    place = F.concat_ws(":", "file", F.col("line").cast("string"), F.col("column").cast("string"))
    return findings.select(F.concat_ws("  ", place, "severity", "rule_id", "message").alias("line"))


def ndjson_lines(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct(*FINDING)).alias("line"))


def _rows(findings: DataFrame) -> list[dict]:
    return [{k: v for k, v in r.asDict().items() if k in FINDING and v is not None} for r in findings.toLocalIterator()]


def json_report(result: Scan, root: str, skipped: int = 0, show_suppressed: bool = False) -> str:
    rows, stats = _rows(result.findings), result.stats().first()
    counts = {s: sum(r["severity"] == s for r in rows) for s in SEVERITIES}
    summary = {"total": len(rows), "bySeverity": counts, "filesScanned": stats.files_scanned, "filesSkipped": skipped}
    hidden = _rows(result.suppressed) if show_suppressed else []
    errors = [r.asDict() for r in result.errors.collect()]
    report = {"tool": {"name": TOOL, "version": VERSION}, "root": root, "generatedAt": datetime.now(UTC).isoformat(), "summary": summary, "findings": rows, "suppressed": hidden, "errors": errors}
    return json.dumps(report, indent=2, ensure_ascii=False) + "\n"


def sarif_rule(r: Rule) -> dict:
    return {
        "id": r.id, "name": re.sub("[^A-Za-z0-9]", "", r.title), "shortDescription": {"text": r.title}, "fullDescription": {"text": r.message},
        "defaultConfiguration": {"level": SARIF_LEVEL[SEVERITIES[r.severity]]}, "properties": {"tags": ["security", "prompt-injection", r.family], "security-severity": SARIF_SCORE[SEVERITIES[r.severity]]},
    }


def sarif_result(r: dict) -> dict:
    return {
        "ruleId": r["rule_id"], "level": SARIF_LEVEL[r["severity"]], "message": {"text": r["message"]},
        "properties": {"security-severity": SARIF_SCORE[r["severity"]], "fingerprint": r["fingerprint"]}, "partialFingerprints": {f"{TOOL}Fingerprint": r["fingerprint"]},
        "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file"], "uriBaseId": "%SRCROOT%"}, "region": {"startLine": r["line"], "startColumn": r["column"], "snippet": {"text": r["snippet"]}}}}],
    }


def sarif_report(result: Scan, rules: list[Rule] | None = None) -> str:
    rows = _rows(result.findings)
    used = {r["rule_id"] for r in rows}
    described, results = [sarif_rule(r) for r in rules or RULES if r.id in used], [sarif_result(r) for r in rows]
    driver = {"name": TOOL, "version": VERSION, "rules": described}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}, indent=2, ensure_ascii=False) + "\n"


def use_color(environ=os.environ, stream=sys.stdout) -> bool:
    """NO_COLOR, then FORCE_COLOR, then a dumb terminal, then CI, then whether a terminal listens."""
    if environ.get("NO_COLOR"):
        return False
    if "FORCE_COLOR" in environ:
        return environ["FORCE_COLOR"] != "0"
    if environ.get("TERM") == "dumb":
        return False
    return bool(environ.get("CI")) or stream.isatty()


def human_report(result: Scan, root: str, skipped: int = 0, quiet: bool = False, color: bool = False, hidden: int = 0) -> str:
    paint = lambda text, code: f"\x1b[{code}m{text}\x1b[0m" if color else text
    rows, out = _rows(result.findings), []
    if not quiet:
        out += ["", f"{paint(TOOL, '35;1')} {root}", ""]
    scanned = result.stats().first().files_scanned
    if not rows:
        out.append(f"  No findings. ({scanned} files)")
    for severity in reversed(SEVERITIES):
        mine = [r for r in rows if r["severity"] == severity]
        if mine:
            out += [f"{paint(severity.upper(), COLORS[severity])} ({len(mine)})", ""]
        files: dict[str, list[dict]] = {}
        for r in mine:
            files.setdefault(r["file"], []).append(r)
        for file, group in files.items():
            out.append(f"  {paint(file, '36;4')}")
            for r in group:
                out += [f"    {r['line']}:{r['column']}  {r['rule_title']}  {r['rule_id']}", f"       > {r['context'] or r['snippet']}"]
                out += textwrap.wrap(r["message"], 72, initial_indent=" " * 7, subsequent_indent=" " * 9)
                if "boosted_by" in r:
                    out.append(f"       ^ raised from {r['base_severity']}: {r['boosted_by']}")
            out.append("")
    if rows:
        counts = [f"{n} {s}" for s in reversed(SEVERITIES) if (n := sum(r["severity"] == s for r in rows))]
        out.append(f"  {len(rows)} finding{'s' * (len(rows) != 1)}: {', '.join(counts)}")
    if not quiet:
        out.append(f"  {scanned} files scanned, {skipped} skipped" + (f", {hidden} suppressed" if hidden else ""))
    errors = result.errors.collect()
    if errors:
        out.append(f"  {len(errors)} file(s) were not fully scanned:")
        out += [f"    {e.file}: {e.message}" for e in errors[:5]] + ([f"    ...and {len(errors) - 5} more"] if len(errors) > 5 else [])
    return "\n".join([*out, ""]) + "\n"
