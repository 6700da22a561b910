"""Command line: scans a folder or file and reports.  Exit code 0: fine, 1: a finding at or above --fail-on, 2: an error."""

from __future__ import annotations

import argparse
import os
import sys

from .operators.detectors import RULES, select_rules
from .operators.model import SEVERITIES, severity_rank
from .plans import baseline, config, report
from .plans.scan import scan
from .sinks import baselines
from .sinks.documents import save_report
from .sources.files import MAX_FILE_SIZE, read_files, walk
from .sources.tree import Filters, read_tree, tree


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=report.TOOL, description="Finds text written to manipulate AI agents.")
    many = {"action": "append", "default": []}
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("-f", "--format", choices=["human", "compact", "json", "ndjson", "sarif", "github"], default="human")
    p.add_argument("-s", "--severity", choices=SEVERITIES)
    p.add_argument("--fail-on", choices=[*SEVERITIES, "never"])
    p.add_argument("-e", "--exclude", **many)
    p.add_argument("--include", **many)
    p.add_argument("--allow", **many)
    p.add_argument("--rules", **many)
    p.add_argument("--disable-rule", **many)
    p.add_argument("-b", "--baseline")
    p.add_argument("--write-baseline", nargs="?", const=baseline.FILENAME)
    p.add_argument("--show-suppressed", action="store_true")
    p.add_argument("-o", "--output")
    p.add_argument("--color", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--no-gitignore", action="store_true")
    p.add_argument("--no-boost", action="store_true")
    p.add_argument("--no-config", action="store_true")
    p.add_argument("--follow-symlinks", action="store_true")
    p.add_argument("--max-file-size", type=float, help="KiB")
    p.add_argument("--max-findings", type=int, default=0)
    p.add_argument("--concurrency", type=int)
    p.add_argument("--list-rules", action="store_true")
    p.add_argument("-v", "--version", action="version", version=report.VERSION)
    return p


def listed(values: list[str]) -> list[str]:
    return [x.strip() for v in values for x in v.split(",") if x.strip()]


def rules_text() -> str:
    families = dict.fromkeys(r.family for r in RULES)
    return "\n".join(line for f in families for line in [f, *(f"  {r.id}  [{SEVERITIES[r.severity]}]  {r.title}" for r in RULES if r.family == f)]) + "\n"


def run(argv: list[str], spark=None) -> int:
    a = parser().parse_args(argv)
    if a.list_rules:
        sys.stdout.write(rules_text())
        return 0
    remote = "://" in a.path  # listed and read by tasks; configuration and baselines beside it are not looked for
    if not remote and not os.path.exists(a.path):
        raise FileNotFoundError(f"no such path: {a.path}")
    folder = a.path if os.path.isdir(a.path) else os.path.dirname(os.path.abspath(a.path))
    c, source = ({}, None) if a.no_config or remote else config.load(folder)
    home = os.path.dirname(source) if source else folder
    # the command line wins over the file, the file over defaults; lists add up, but rules replace
    rules = select_rules(listed(a.rules) or c.get("rules"), [*listed(a.disable_rule), *c.get("disableRules", [])])
    base = os.path.relpath(os.path.abspath(folder), home).replace(os.sep, "/")
    known_path = a.baseline or c.get("baseline") and os.path.join(home, c["baseline"])
    table = bool(known_path) and os.path.isdir(known_path)  # a folder holds a baseline table
    known = {} if a.write_baseline or table else baseline.load(known_path) if known_path else {} if remote else baseline.load_if_present(os.path.join(folder, baseline.FILENAME))
    size = a.max_file_size or c.get("maxFileSize")
    limit = int(size * 1024) if size else MAX_FILE_SIZE
    filters = dict(exclude=(*a.exclude,), include=(*a.include,), scoped_exclude=(*c.get("exclude", ()),), scoped_include=(*c.get("include", ()),), base="" if base == "." else base, respect_gitignore=not a.no_gitignore and c.get("respectGitignore", True), max_file_size=limit, follow_symlinks=a.follow_symlinks or c.get("followSymlinks", False))
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName(report.TOOL).getOrCreate()
    tasks = a.concurrency or int(c.get("concurrency", 16))
    if remote:
        found = tree(spark, a.path, Filters(**filters), tasks)
        files, unread = read_tree(a.path, found, tasks).cache(), found.errors
    else:
        found = walk(a.path, **filters)
        files, unread = read_files(spark, found, tasks).cache(), spark.createDataFrame(found.errors, "file string, message string")
    failed = files.where("error is not null").select(files.path.alias("file"), files.error.alias("message"))
    result = scan(files.select("path", "text").where("text is not null"), rules, baselines.current(spark, known_path) if table and not a.write_baseline else baseline.table(spark, known), [*a.allow, *c.get("allow", [])], a.severity or c.get("severity", "low"), not a.no_boost, a.max_findings)
    result.errors = result.errors.unionByName(failed).unionByName(unread)
    if a.write_baseline and (a.write_baseline.endswith("/") or os.path.isdir(a.write_baseline)):
        version = baselines.merge(spark, a.write_baseline, baselines.entries(result.findings))
        print(f"version {version} of {a.write_baseline} written", file=sys.stderr)
        return 0
    if a.write_baseline:
        n = baseline.write(result.findings, a.write_baseline)
        print(f"{n} findings accepted in {a.write_baseline}", file=sys.stderr)
        return 0
    skipped = found.skipped + failed.count()
    if a.output and a.format in ("json", "sarif"):
        save_report(result, a.output, a.format, a.path, skipped, a.show_suppressed)
        return exit_code(a, c, result)
    text = render(a, result, skipped)
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text)
    return exit_code(a, c, result)


def exit_code(a, c: dict, result) -> int:
    bar = a.fail_on or c.get("failOn", "high")
    return int(bar != "never" and bool(result.findings.where(result.findings["rank"] >= severity_rank(bar)).take(1)))


def render(a, result, skipped: int) -> str:
    lines = {"compact": report.compact_lines, "ndjson": report.ndjson_lines, "github": report.github_lines}
    if a.format in lines:
        return "".join(r.line + "\n" for r in lines[a.format](result.findings).toLocalIterator())
    if a.format == "json":
        return report.json_report(result, a.path, skipped, a.show_suppressed)
    if a.format == "sarif":
        return report.sarif_report(result)
    color = a.color if a.color is not None else not a.output and report.use_color()
    return report.human_report(result, a.path, skipped, a.quiet, color, result.suppressed.count() if a.show_suppressed else 0)


def main(argv: list[str] | None = None) -> int:
    try:
        return run(sys.argv[1:] if argv is None else argv)
    except (OSError, ValueError) as e:
        print(f"{report.TOOL}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
