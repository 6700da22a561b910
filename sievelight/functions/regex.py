"""Regular expressions as Spark expressions: dialect, offsets, windows.

Patterns are written in the ECMAScript dialect.  :func:`java` gives the form that Spark's engine needs: ASCII
word boundaries, the wide white-space class, ``$`` at the very end, and possessive group loops (a greedy loop over a
group recurses once per round in Java, and a long enough text would overflow the executor's stack).
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of ECMAScript beyond Java's \s, and an ASCII word boundary.
WIDE = r"\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
BOUNDARY = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
SUPPLEMENTARY = r"[\x{10000}-\x{10FFFF}]"
LINE_START = r"(?<![^\n\r\x{2028}\x{2029}])"

_TOKEN = re.compile(r"\[\^\\S\\n\]|\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\.|\[\^?\]?|\]|\^|\$|\)(?:\*|\{\d+,\})(?![+?])|.", re.S)


def java(pattern: str, flags: str = "") -> str:
    """The Java form of an ECMAScript pattern with the flags ``i`` and ``m``."""
    out, inside = [], False
    for m in _TOKEN.finditer(pattern):
        t = m[0]
        if m[1] or m[2]:
            out.append(rf"\x{{{m[1] or m[2]}}}")
        elif t == r"[^\S\n]":
            out.append(rf"[\s{WIDE}&&[^\n]]")
        elif t == r"\s":
            out.append(rf"\s{WIDE}" if inside else rf"[\s{WIDE}]")
        elif t == r"\S" and not inside:
            out.append(rf"[^\s{WIDE}]")
        elif t == r"\b" and not inside:
            out.append(BOUNDARY)
        elif t.startswith("[") and not inside:
            inside = True
            out.append(t)
        elif t == "[":
            out.append(r"\[")
        elif t == "]" and inside:
            inside = False
            out.append(t)
        elif t == "&" and inside:
            out.append(r"\&")
        elif t == "$" and not inside:
            out.append(r"\z")
        elif t == "^" and not inside and "m" in flags:
            out.append(LINE_START)
        elif t[0] == ")" and len(t) > 1 and not inside:
            out.append(t + "+")
        else:
            out.append(t)
    return ("(?i)" if "i" in flags else "") + "".join(out)


_OPEN = re.compile(r"\((?:\?(?:[:>]|(<?[=!])))?")
_CLASS = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]", re.S)
_ESCAPE = re.compile(r"\\(?:u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|.)", re.S)
_TIMES = re.compile(r"(?:[*?]|(\+)|\{(\d+)(?:,\d*)?\})[?+]?")


_EVERYWHERE = {"all", "and", "are", "for", "have", "that", "the", "this", "with", "you", "your"}
_MOST_JOINED = 16


class _Repeated(tuple):
    """Branches that may occur more than once in a row."""


def worth(group: Collection[str]) -> tuple[int, int]:
    """Of two groups of literals, the one that is worth more is in fewer texts."""
    return min(1 if word in _EVERYWHERE else len(word) for word in group), -len(group)


def needles(pattern: str) -> tuple[tuple[str, ...], ...]:
    """What a text must contain, in lower case, to match: one literal of each group.  Finding literals is much cheaper than a pattern."""

    def branches(i: int) -> tuple[list[list], int]:
        """The branches up to the closing bracket, as lists of characters, (branches) that occur, and None for all else."""
        out: list[list] = [[]]
        while i < len(pattern) and pattern[i] != ")":
            c = pattern[i]
            if c == "|":
                out.append([])
                i += 1
                continue
            if c == "(":
                m = _OPEN.match(pattern, i)
                inner, i = branches(m.end())
                item = None if m[1] else tuple(inner)
            elif c in "[\\":
                m = (_CLASS if c == "[" else _ESCAPE).match(pattern, i)
                item, i = None if c == "[" or m[0][1].isalnum() else m[0][1], m.end()
            else:
                item, i = None if c in "^$." else c, i + 1
            times = _TIMES.match(pattern, i)
            if times:
                i = times.end()
                often = times[1] or int(times[2] or 0)
                item = _Repeated(([item],) if isinstance(item, str) else item or ()) if often else None
            out[-1].append(item)
        return out, i + 1

    def plain(item) -> list[str] | None:
        """All that an item can be, if that is few literals."""
        if isinstance(item, str):
            return [item.lower()]
        if not item or isinstance(item, _Repeated):
            return None
        out: list[str] = []
        for branch in item:
            made = [""]
            for x in branch:
                more = plain(x)
                if more is None or len(made) * len(more) > _MOST_JOINED:
                    return None
                made = [a + b for a in made for b in more]
            out += made
        return out if len(out) <= _MOST_JOINED else None

    def of(items: list) -> list[frozenset]:
        out, run = [], [""]
        for item in [*items, None]:
            more = plain(item)
            # literals and short choices between them are joined to longer ones
            if more and len(run) * len(more) <= _MOST_JOINED:
                run = [a + b for a in run for b in more]
                continue
            if all(x.strip() for x in run):
                out.append(frozenset(run))
            run = [""]
            if more:
                run = more
                continue
            if item and len(item) == 1:
                out += of(item[0])
            elif item:
                groups = [of(branch) for branch in item]
                out += [frozenset().union(*(max(g, key=worth) for g in groups))] if all(groups) else []
        return out

    every = branches(0)[0]
    return tuple(tuple(sorted(g)) for g in dict.fromkeys(of(every[0] if len(every) == 1 else [tuple(every)])))


MATCH = "array<struct<idx: int, units: int, match: string>>"
BLOCK = 256  # matches in a row before they are put aside


def once(value: Column, make) -> Column:
    """``make`` of a value that is computed once, however often it reads it."""
    return F.transform(F.array(value), make)[0]


def matches(text: Column, pattern: Column | str) -> Column:
    """``array<struct<idx, units, match>>``: offsets (in code points, and in UTF-16 units) and texts of all matches of a Java pattern.

    The pattern must consume something.  It may differ by row, so one expression serves many patterns.  Spark copies what an
    aggregation has gathered at every step, so offsets are summed block by block: first the blocks' lengths, then within each.
    """
    p = pattern if isinstance(pattern, Column) else F.lit(pattern)
    found, between = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, p, -1)
    more = lambda x: F.regexp_count(x, F.lit(SUPPLEMENTARY))
    after = lambda acc, x: (acc["at"] + x["skip"] + x["size"], acc["units"] + x["skip_units"] + x["units"])
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("units"))

    def pair(a, b):
        skip, size = F.length(b), F.length(a)
        return F.struct(a.alias("match"), skip.alias("skip"), size.alias("size"), (skip + more(b)).alias("skip_units"), (size + more(a)).alias("units"))

    def moved(acc, x):
        at, units = after(acc, x)
        return F.struct(at.alias("at"), units.alias("units"))

    def summed(acc, x):
        now = F.get(acc, F.size(acc) - 1)
        return F.concat(acc, F.array(F.struct((now["at"] + x["at"]).alias("at"), (now["units"] + x["units"]).alias("units"))))

    def located(block, start):
        def add(acc, x):
            at, units = after(acc, x)
            one = F.struct((acc["at"] + x["skip"]).alias("idx"), (acc["units"] + x["skip_units"]).alias("units"), x["match"].alias("match"))
            return F.struct(at.alias("at"), units.alias("units"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(block, F.struct(start["at"].alias("at"), start["units"].alias("units"), F.array().cast(MATCH).alias("out")), add, lambda acc: acc["out"])

    # the piece behind the last match meets no match and is left out
    pairs = F.filter(F.zip_with(found, between, pair), lambda x: x["match"].isNotNull())
    blocks = once(pairs, lambda ps: F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / BLOCK).cast("int")), lambda i: F.slice(ps, i * BLOCK + 1, F.lit(BLOCK))))
    starts = lambda bs: F.aggregate(F.transform(bs, lambda b: F.aggregate(b, zero, moved)), F.array(zero), summed)
    out = once(blocks, lambda bs: once(starts(bs), lambda at: F.flatten(F.transform(bs, lambda b, i: located(b, F.get(at, i))))))
    return F.when(F.size(found) > 0, out).otherwise(F.array().cast(MATCH))
