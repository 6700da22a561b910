"""JSON and SARIF reports as a Spark data source: tasks write parts, the commit puts head, parts and tail together.

    rows.write.format("finding_report").option("kind", "sarif").option("path", target).mode("overwrite").save()

A task turns its rows into text and writes them, by section, below ``<path>.parts``; it sends on only counts and the rules it met.  The driver
copies the parts, in the order of the partitions, a megabyte at a time, so its memory does not grow with the report.  Lost or repeated
attempts leave files that no commit names; the parts go when the report stands, or when the job fails.  Paths may be of any file system that
pyarrow knows, shared by driver and executors.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.detectors import RULES
from ..operators.model import SEVERITIES
from ..plans.report import FINDING, TOOL, VERSION, Scan, sarif_result, sarif_rule

SECTIONS = ("findings", "suppressed", "errors")
PIECE = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: files by section, and counts."""

    number: int
    files: dict[str, str] = field(default_factory=dict)
    rows: Counter = field(default_factory=Counter)
    severities: Counter = field(default_factory=Counter)
    rules: set[str] = field(default_factory=set)


def _item(kind: str, section: str, row: dict) -> dict:
    if section == "errors":
        return {"file": row["file"], "message": row["message"]}
    found = {k: row[k] for k in FINDING if row[k] is not None}
    return sarif_result(found) if kind == "sarif" else found


class _Report(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.kind, self.overwrite, self.options = options["kind"], overwrite, dict(options)
        self.system, self.path = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (fs.LocalFileSystem(), options["path"])
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"
        if not overwrite and self.system.get_file_info(self.path).type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} exists")

    def write(self, iterator) -> Part:
        number, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        self.system.create_dir(self.parts, recursive=True)
        part, open_ = Part(number), {}
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    section = row["section"]
                    if section not in open_:
                        part.files[section] = f"{self.parts}/{section}-{number}-{attempt}"
                        open_[section] = self.system.open_output_stream(part.files[section])
                    open_[section].write((",\n" if part.rows[section] else "").encode() + json.dumps(_item(self.kind, section, row), ensure_ascii=False).encode())
                    part.rows[section] += 1
                    if section == "findings":
                        part.severities[row["severity"]] += 1
                        part.rules.add(row["rule_id"])
        finally:
            for stream in open_.values():
                stream.close()
        return part

    def _copy(self, out, parts: list[Part], section: str) -> None:
        out.write(b"[")
        first = True
        for name in (p.files[section] for p in parts if section in p.files):
            out.write(b"\n" if first else b",\n")
            first = False
            with self.system.open_input_stream(name) as part:
                while piece := part.read(PIECE):
                    out.write(piece)
        out.write(b"]")

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m), key=lambda p: p.number)
        target = f"{self.parts}.whole"
        with self.system.open_output_stream(target) as out:
            say = lambda **x: out.write(json.dumps(x, ensure_ascii=False)[1:-1].encode())
            if self.kind == "sarif":
                used = set().union(*(p.rules for p in parts))
                out.write(b"{")
                say(**{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0"})
                out.write(b', "runs": [{')
                say(tool={"driver": {"name": TOOL, "version": VERSION, "rules": [sarif_rule(r) for r in RULES if r.id in used]}})
                out.write(b', "results": ')
                self._copy(out, parts, "findings")
                out.write(b"}]}\n")
            else:
                severities = sum((p.severities for p in parts), Counter())
                total = sum(p.rows["findings"] for p in parts)
                out.write(b"{")
                say(tool={"name": TOOL, "version": VERSION}, root=self.options.get("root", "."), generatedAt=datetime.now(UTC).isoformat())
                out.write(b", ")
                say(summary={"total": total, "bySeverity": {s: severities[s] for s in SEVERITIES}, "filesScanned": int(self.options.get("scanned", 0)), "filesSkipped": int(self.options.get("skipped", 0))})
                for section in SECTIONS:
                    out.write(f', "{section}": '.encode())
                    self._copy(out, parts, section)
                out.write(b"}\n")
        self.system.move(target, self.path)
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        if self.system.get_file_info(self.parts).type != fs.FileType.NotFound:
            self.system.delete_dir(self.parts)


class FindingReport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "finding_report"

    def writer(self, schema, overwrite: bool) -> _Report:
        if self.options.get("kind") not in ("json", "sarif"):
            raise ValueError("kind is json or sarif")
        return _Report(self.options, overwrite)


def report_rows(result: Scan, show_suppressed: bool = False) -> DataFrame:
    """All rows of a report: findings in order, then, if asked, suppressed ones, then errors; ``section`` tells them apart."""
    empty = [F.lit(None).cast(t).alias(c) for c, t in result.findings.select(*FINDING).dtypes if c not in ("file", "message")]
    out = result.findings.select(F.lit("findings").alias("section"), *FINDING)
    if show_suppressed:
        out = out.unionByName(result.suppressed.select(F.lit("suppressed").alias("section"), *FINDING))
    return out.unionByName(result.errors.select(F.lit("errors").alias("section"), "file", "message", *empty))


def save_report(result: Scan, path: str, kind: str, root: str = ".", skipped: int = 0, show_suppressed: bool = False) -> None:
    """Writes a JSON or SARIF report of any size; the findings keep their order."""
    spark: SparkSession = result.findings.sparkSession
    spark.dataSource.register(FindingReport)
    scanned = result.stats().first()["files_scanned"] if kind == "json" else 0
    rows = report_rows(result, show_suppressed) if kind == "json" else result.findings.select(F.lit("findings").alias("section"), *FINDING)
    rows.write.format("finding_report").options(kind=kind, path=path, root=root, skipped=str(skipped), scanned=str(scanned)).mode("overwrite").save()
