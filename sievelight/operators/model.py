"""Severities, rules and the row shapes of the scanner."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import narrow

# Severities from least to most.
SEVERITIES = ("info", "low", "medium", "high", "critical")
INFO, LOW, MEDIUM, HIGH, CRITICAL = range(5)

#: What a detector returns per document: offset, matched text, rank (null: the rule's), message (null: the rule's), details as JSON.
RAW = "struct<idx: int, match: string, severity: int, message: string, detail: string>"
RAWS = f"array<{RAW}>"


@dataclass(frozen=True)
class Document:
    """The columns of a prepared document that a rule's own scan reads."""

    path: Column
    text: Column  # comment continuation markers blanked, same length as the original
    spans: Column  # array<struct<start, end>> of prose; unused in whole-text documents
    whole: Column  # the whole text is prose
    agent_file: Column


@dataclass(frozen=True)
class Match:
    """One match of a pattern: offset, text, its surroundings, and what its pattern carries along."""

    at: Column
    text: Column
    near: Column  # the pattern's ``near`` characters on either side of the offset, in UTF-16 units; null if it looks at none
    lead: Column  # how many of them stand before the offset
    after: Column  # the same around the end of the match
    lead_after: Column
    prose: Column  # the offset is in prose
    whole: Column
    pattern: Column
    label: Column

    def around(self, radius: int) -> Column:
        """Up to ``radius`` characters on either side of the offset."""
        return _middle(self.near, self.lead, radius)

    def around_end(self, radius: int) -> Column:
        return _middle(self.after, self.lead_after, radius)


def _middle(near: Column, lead: Column, radius: int) -> Column:
    begin = F.greatest(lead - radius, F.lit(0))
    return narrow(F.substring(near, begin + 1, lead + radius - begin))


@dataclass(frozen=True)
class Pattern:
    """One pattern of a rule (Java dialect).

    ``gate`` is the search that decides whether a text is matched at all (default: the pattern); before it come ``needles`` (see
    :func:`..functions.regex.needles`) and, with ``foreign``, that the text has characters beyond ASCII.  ``confirm`` is a second-stage check
    of a match, ``near`` tells how far it looks around; ``report`` turns a match into a raw finding or null (default: the match itself with
    ``severity``).  Patterns that share a function share its branch of the plan; ``label`` tells them apart.
    """

    java: str
    severity: int | None = None
    anywhere: bool = True
    first_only: bool = False
    gate: str | None = None
    needles: tuple[tuple[str, ...], ...] = ()
    foreign: bool = False
    confirm: Callable[[Match], Column] | None = None
    report: Callable[[Match], Column] | None = None
    near: int = 0
    label: str | None = None


@dataclass(frozen=True)
class Rule:
    """A detector: patterns, a function from a document's columns to an array of raw findings, or a Python function.

    ``call`` takes (path, text) and yields ``(offset, match, rank or None, message or None)``.  Where a pattern, ``scan`` or ``call`` raises, the file gets
    an error row for that rule, and the other rules go on; a pattern's ``confirm`` and ``report`` must not raise.
    ``dedupe``: of overlapping matches the first and longest counts.
    """

    id: str
    title: str
    family: str
    severity: int
    message: str
    patterns: tuple[Pattern, ...] = field(default=(), repr=False)
    scan: Callable[[Document], Column] | None = field(default=None, repr=False)
    dedupe: bool = False
    call: Callable | None = field(default=None, repr=False)


def raw(at: Column, match: Column, severity=None, message=None, **detail: Column) -> Column:
    column = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    details = F.to_json(F.struct(*[v.alias(k) for k, v in detail.items()])) if detail else F.lit(None).cast("string")
    return F.struct(at.cast("int").alias("idx"), match.alias("match"), column(severity, "int").alias("severity"), column(message, "string").alias("message"), details.alias("detail"))


def severity_rank(name: str) -> int:
    if name not in SEVERITIES:
        raise ValueError(f"no such severity: {name}; one of {', '.join(SEVERITIES)}")
    return SEVERITIES.index(name)


def is_severity(name: object) -> bool:
    return name in SEVERITIES


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1)


def bump(rank: Column, by: Column | int) -> Column:
    """A rank raised by some levels, kept within the scale."""
    return F.least(F.greatest(rank + by, F.lit(0)), F.lit(len(SEVERITIES) - 1))
