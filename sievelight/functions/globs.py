"""Ignore-file globs, compiled on the driver to regular expressions for Python and for Spark."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Glob:
    source: str
    negated: bool
    directory_only: bool
    regex: str  # the path itself or anything below it
    below: str  # only what is below it


def _body(pattern: str) -> str:
    """The regular expression of a glob without its anchors.

    ``*`` and ``?`` stay within a segment; ``**`` as a whole segment spans segments, otherwise it is ``*``; classes may be
    negated by ``!`` or ``^`` and may begin with a literal ``]``; an open class is a literal bracket.
    """
    out, rest = [], pattern
    rules = (
        (r"\\(.)", lambda m: re.escape(m[1])),
        (r"\*\*/", lambda m: "(?:.*/)?" if m[0] and starts() else "[^/]*/"),
        (r"\*\*(?=\Z)", lambda m: ".*" if starts() else "[^/]*"),
        (r"\*\*?", lambda m: "[^/]*"),
        (r"\?", lambda m: "[^/]"),
        (r"\[([!^]?)(\]?[^\]]*)\]", lambda m: f"[{'^' if m[1] else ''}{_class(m[2])}]"),
        (r"[\s\S]", lambda m: re.escape(m[0])),
    )

    def starts() -> bool:
        done = len(pattern) - len(rest)
        return done == 0 or pattern[done - 1] == "/"

    while rest:
        for rule, make in rules:
            m = re.match(rule, rest, re.S)
            if m:
                out.append(make(m))
                rest = rest[m.end() :]
                break
    return "".join(out)


def _class(body: str) -> str:
    escaped = body.replace("\\", "\\\\").replace("[", r"\[").replace("&&", r"&\&")
    return "\\" + escaped if escaped.startswith(("]", "^")) else escaped


def compile_glob(line: str) -> Glob | None:
    """One line of an ignore file; None for comments and blank lines."""
    pattern = re.sub(r"(?<!\\)\s+\Z", "", line)
    if not pattern or pattern.startswith("#"):
        return None
    negated = pattern.startswith("!")
    if negated or pattern.startswith("\\!"):
        pattern = pattern[1:]
    directory_only = pattern.endswith("/")
    pattern = pattern.removesuffix("/")
    anchor = "^" if "/" in pattern else "^(?:.*/)?"
    body = _body(pattern.removeprefix("/"))
    return Glob(line, negated, directory_only, rf"{anchor}{body}(?:/.*)?\z", rf"{anchor}{body}/.+\z")


class GlobSet:
    """Globs in order; the last that matches decides."""

    def __init__(self, lines: Iterable[str] = ()):
        self.globs = [g for g in map(compile_glob, lines) if g]
        self._compiled = [(re.compile(g.regex.replace(r"\z", r"\Z"), re.S), re.compile(g.below.replace(r"\z", r"\Z"), re.S), g) for g in self.globs]

    def __len__(self) -> int:
        return len(self.globs)

    def matches(self, path: str, is_dir: bool = False) -> bool:
        hit = False
        for regex, below, g in self._compiled:
            if (below if g.directory_only and not is_dir else regex).match(path):
                hit = not g.negated
        return hit

    def column(self, path: Column, is_dir: bool = False) -> Column:
        """The same decision as a Spark expression."""
        hit = F.lit(False)
        for g in self.globs:
            hit = F.when(path.rlike("(?s)" + (g.below if g.directory_only and not is_dir else g.regex)), F.lit(not g.negated)).otherwise(hit)
        return hit

    def excluded(self, path: Column) -> Column:
        """Whether a file or any folder above it is matched."""
        parts = F.split(path, "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
        folders = F.when(F.size(parts) > 1, F.exists(above, lambda d: self.column(d, True))).otherwise(F.lit(False))
        return folders | self.column(path)
