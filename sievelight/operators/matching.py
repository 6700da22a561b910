"""Where the patterns of a scan match, and where matches stand in their text.

Two Arrow functions.  :func:`scanned` finds the prose of a text and goes once through it with an automaton of the patterns' literals; only patterns
whose literals are there are tried.  :func:`located` finds lines, columns and the surroundings of the findings that are left, by binary search in the
offsets of the newlines.  All that follows (confirmation, reports, correlation, order) are Spark expressions over small columns.

Patterns are given in the Java dialect of :mod:`..functions.regex`; :func:`compiled` gives their Python form.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regex import BOUNDARY, WIDE, worth
from ..functions.shared import gathered
from ..functions.text import FILL
from .prose import SPANS, SPANS_KIND, as_spans, lexed

HIT = "struct<k: int, idx: int, match: string, prose: boolean, near: string, lead: int, after: string, lead_after: int>"
HITS = f"struct<hits: array<{HIT}>, failed: array<struct<k: int, why: string>>, text: string, spans: {SPANS}>"
PLACE = "struct<line: int, column: int, left: string, behind: string, own: string, above: string>"
Spec = tuple  # (java, gate, needles, foreign, first_only, near) of a pattern

_SUPPLEMENTARY = re.compile("([\U00010000-\U0010ffff])")


@lru_cache(maxsize=1024)
def compiled(java: str):
    """A Java pattern for Python: classes and case are ASCII in both; what only Java has goes to a module that knows it."""
    p = java.replace(BOUNDARY, r"\b").replace(rf"[\s{WIDE}&&[^\n]]", rf"[ \t\r\f\v{WIDE}]").replace(r"\z", r"\Z")
    p = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: rf"\U{int(m[1], 16):08X}", p)
    return regex.compile(p, regex.V1) if r"\p{" in p or "&&" in p else re.compile(p, re.ASCII)


_CHARACTER = r"(?:\\x\{[0-9A-Fa-f]+\}|\\x[0-9A-Fa-f]{2}|\\[tfr]|[A-Za-z0-9+/ ])"
_SET = re.compile(rf"(?:\(\?<!\[[^\[\]\\]*\]\))?\[((?:{_CHARACTER}(?:-{_CHARACTER})?)+)\](?:\+|\{{(\d+)(?:,|)\}})?")
_ORDINARY = bytes(range(32, 127)) + b"\t\n\r"


def _code(character: str) -> int:
    return int(character[2:].strip("{}"), 16) if character.startswith("\\x") else ord({"\\t": "\t", "\\f": "\f", "\\r": "\r"}.get(character, character))


def marks(java: str) -> tuple[frozenset[int], bytes, int] | None:
    """Of a pattern that is a run of one set of characters: the first bytes of those in UTF-8, a table that maps all their bytes to one and all other
    bytes to zero, and the least length of a run; else nothing."""
    whole = _SET.fullmatch(java)
    if not whole:
        return None
    spans = [(_code(a), _code(b or a)) for a, b in re.findall(rf"({_CHARACTER})(?:-({_CHARACTER}))?", whole[1])]
    if any(a > b for a, b in spans):
        return None
    lead = lambda c: chr(c).encode("utf-8", "surrogatepass")[0]
    foreign = any(b > 127 for _, b in spans)
    table = bytes(c > 127 and foreign or any(a <= c <= min(b, 127) for a, b in spans) for c in range(256))
    return frozenset(x for a, b in spans for x in range(lead(a), lead(b) + 1)), table, int(whole[2] or 1)


class Matcher:
    """The patterns of a scan: each waits for one of its literals, the rarest kind of them; one automaton finds all literals but the shortest.

    Runs of rare characters are looked up among the text's bytes, and long runs of any as runs of bytes.
    """

    def __init__(self, specs: tuple[Spec, ...]):
        self.specs = specs
        self.rare, self.runs = {}, {}
        for k, (java, gate, *_) in enumerate(specs):
            if found := marks(gate or java):
                first, table, least = found
                if least >= 8:
                    self.runs[k] = table, b"\1" * least
                elif first.isdisjoint(_ORDINARY):
                    self.rare[k] = first
        number: dict[str, int] = {}
        waiting: dict[int, list[int]] = {}
        self.always, self.others = [], []
        for k, (_, _, needles, *_) in enumerate(specs):
            best = max(needles, key=worth) if needles else None
            if best is None:
                self.always.append(k)
            for word in best or ():
                waiting.setdefault(number.setdefault(word, len(number)), []).append(k)
            # one or two characters are soon found in a text, and often
            rest = [[word for word in group if len(word) > 2] for group in needles if group is not best]
            short = [[word for word in group if len(word) <= 2] for group in needles if group is not best]
            self.others.append([(frozenset(number.setdefault(word, len(number)) for word in a), b) for a, b in zip(rest, short, strict=True)])
        self.automaton, self.waiting = ahocorasick.Automaton(), [waiting.get(i, []) for i in range(len(number))]
        for word, i in number.items():
            self.automaton.add_word(word, i)
        if number:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """The patterns whose literals are in the text."""
        lower, plain = text.lower(), text.isascii()
        words = {i for _, i in self.automaton.iter(lower)} if len(self.automaton) else set()
        found = set(self.always).union(*[self.waiting[i] for i in words])
        data = text.encode("utf-8", "surrogatepass") if self.rare or self.runs else b""
        odd = set(data.translate(None, _ORDINARY)) if self.rare else ()

        def there(k: int) -> bool:
            if plain and self.specs[k][3] or k in self.rare and self.rare[k].isdisjoint(odd):
                return False
            if k in self.runs and self.runs[k][1] not in data.translate(self.runs[k][0]):
                return False
            return all(not numbers.isdisjoint(words) or any(word in lower for word in short) for numbers, short in self.others[k])

        return sorted(k for k in found if there(k))

    def hits(self, text: str, starts: list[int], ends: list[int], whole: bool) -> tuple[list[dict], list[dict]]:
        out, failed = [], []
        for k in self.candidates(text):
            java, gate, _, _, first_only, near = self.specs[k]
            try:
                mine = []
                if gate is None or compiled(gate).search(text):
                    for m in compiled(java).finditer(text):
                        at, end = m.span()
                        prose = whole or (i := bisect_right(starts, at) - 1) >= 0 and at < ends[i]
                        one = {"k": k, "idx": at, "match": m[0], "prose": prose}
                        if near:
                            one["near"], one["lead"] = around(text, at, near)
                            one["after"], one["lead_after"] = around(text, end, near)
                        mine.append(one)
                        if first_only:
                            break
                out += mine
            except Exception as e:  # a pattern that fails must not silence the others, nor itself
                failed.append({"k": k, "why": f"{type(e).__name__}: {e}"})
        return out, failed


def filled(text: str) -> str:
    """The text with a filler behind each supplementary character: its characters are UTF-16 units (see :func:`..functions.text.wide`)."""
    return text if text.isascii() else _SUPPLEMENTARY.sub("\\1" + FILL, text)


def around(text: str, at: int, radius: int) -> tuple[str, int]:
    """Up to ``radius`` UTF-16 units on either side of an offset, and how many of them stand before it."""
    head = filled(text[max(0, at - radius) : at])[-radius:]
    return head + filled(text[at : at + radius])[:radius], len(head)


class Lines:
    """The lines of a text, found by binary search; offsets are code points, columns UTF-16 units."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.wide = [m.start() for m in _SUPPLEMENTARY.finditer(text)] if not text.isascii() else []

    def locate(self, at: int) -> tuple[int, int]:
        """1-based line and column."""
        line = bisect_right(self.starts, at)
        start = self.starts[line - 1]
        return line, at - start + 1 + bisect_right(self.wide, at - 1) - bisect_right(self.wide, start - 1)

    def line(self, number: int) -> str:
        """A line's text without its newline; empty beyond either end."""
        if not 1 <= number <= len(self.starts):
            return ""
        end = self.starts[number] - 1 if number < len(self.starts) else len(self.text)
        return self.text[self.starts[number - 1] : end]


def line_around(text: str, at: int) -> str:
    """The line that holds an offset."""
    lines = Lines(text)
    return lines.line(lines.locate(at)[0])


def _place(lines: Lines, at: int, radius: int, marker: re.Pattern) -> dict:
    """Line, column, what stands before an offset in its line and behind it (as much as windows and limits read), and the ignore markers
    of its line and the one above."""
    line, column = lines.locate(at)
    start = lines.starts[line - 1]
    noted = [m[0] if (m := marker.search(x)) else None for x in (lines.line(line), lines.line(line - 1))]
    return {"line": line, "column": column, "left": filled(lines.text[max(start, at - radius - 1) : at])[-radius - 1 :], "behind": filled(lines.text[at : at + radius + 2]), "own": noted[0], "above": noted[1]}


@lru_cache(maxsize=8)
def matcher(specs: tuple[Spec, ...]) -> Matcher:
    return Matcher(specs)


def scanned(specs: tuple[Spec, ...], text: Column, family: Column, prose: bool) -> Column:
    """``HITS`` of a text: all matches of all patterns, in the patterns' order, and the patterns that failed; with ``prose``, also the text
    that rules see where it differs, and the spans of code."""
    kind = pa.struct([
        ("hits", pa.list_(pa.struct([("k", pa.int32()), ("idx", pa.int32()), ("match", pa.string()), ("prose", pa.bool_()), ("near", pa.string()), ("lead", pa.int32()), ("after", pa.string()), ("lead_after", pa.int32())]))),
        ("failed", pa.list_(pa.struct([("k", pa.int32()), ("why", pa.string())]))),
        ("text", pa.string()), ("spans", SPANS_KIND),
    ])

    def one(t: str, f: str, m: Matcher) -> tuple[int, dict]:
        seen, found = lexed(t, f)
        hits, failed = m.hits(seen, [s for s, _, _ in found], [e for _, e, _ in found], f == "document")
        return len(t), {"hits": hits, "failed": failed} | ({"text": seen if seen != t else None, "spans": as_spans(found)} if prose else {})

    def run(text: pa.Array, family: pa.Array) -> pa.Array:
        return gathered((one(t.as_py(), f.as_py(), matcher(specs)) for t, f in zip(text, family, strict=True)), kind)

    # the filter on its hits would have a deterministic function run once more
    return F.arrow_udf(run, HITS).asNondeterministic()(text, family)


def located(text: Column, offsets: Column, radius: int, marker: str) -> Column:
    """``array<PLACE>`` of the offsets (code points) of a text."""
    kind = pa.list_(pa.struct([("line", pa.int32()), ("column", pa.int32()), ("left", pa.string()), ("behind", pa.string()), ("own", pa.string()), ("above", pa.string())]))

    def one(t: str, o: list[int], noted: re.Pattern) -> tuple[int, list[dict]]:
        lines = Lines(t)
        return len(t), [_place(lines, at, radius, noted) for at in o]

    def run(text: pa.Array, offsets: pa.Array) -> pa.Array:
        return gathered((one(t.as_py(), o.as_py(), compiled(marker)) for t, o in zip(text, offsets, strict=True)), kind)

    return F.arrow_udf(run, f"array<{PLACE}>").asNondeterministic()(text, offsets)
