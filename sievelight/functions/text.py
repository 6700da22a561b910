"""Text functions of findings: location, context, visible form, fingerprint."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import SUPPLEMENTARY, WIDE, java

SPACE = rf"[\s{WIDE}]"
ELLIPSIS = "…"
FILL = "\ufdd0"  # a noncharacter

# Names of invisible characters in snippets.
CONTROL_NAMES = {
    0x00AD: "SHY", 0x061C: "ALM", 0x180E: "MVS", 0x200B: "ZWSP", 0x200C: "ZWNJ", 0x200D: "ZWJ", 0x200E: "LRM", 0x200F: "RLM",
    0x202A: "LRE", 0x202B: "RLE", 0x202C: "PDF", 0x202D: "LRO", 0x202E: "RLO", 0x2060: "WJ", 0x2066: "LRI", 0x2067: "RLI",
    0x2068: "FSI", 0x2069: "PDI", 0x3164: "HF", 0xFEFF: "BOM",
}


def constants(table: dict[str, str]) -> Column:
    """A map of constants.  It reaches Spark as one literal, which the optimiser folds, not as a call for each entry."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units; Spark counts code points."""
    return F.length(text) + F.regexp_count(text, F.lit(SUPPLEMENTARY))


def wide(text: Column) -> Column:
    """The text with a filler behind each supplementary character: its characters are UTF-16 units."""
    return F.when(text.rlike(SUPPLEMENTARY), F.regexp_replace(text, f"({SUPPLEMENTARY})", "$1" + FILL)).otherwise(text)


def narrow(text: Column) -> Column:
    """A piece of a :func:`wide` text without fillers.  A character cut in half stays whole at an end, and goes at a start."""
    return F.when(text.contains(FILL), F.translate(text, FILL, "")).otherwise(text)


def wide_at(text: Column, at: Column) -> Column:
    """An offset in code points as one in UTF-16 units."""
    return F.when(text.rlike(SUPPLEMENTARY), utf16_length(F.left(text, at))).otherwise(at).cast("int")


def take(text: Column, limit: int) -> Column:
    """The first ``limit`` UTF-16 units."""
    return narrow(F.left(wide(text), F.lit(limit)))


def line_of(text: Column, at: Column) -> Column:
    """1-based line of an offset; lines end at a newline."""
    return F.regexp_count(F.left(text, at), F.lit("\n")) + 1


def line_head(text: Column, at: Column) -> Column:
    """The part of an offset's line before it."""
    return F.substring_index(F.left(text, at), "\n", -1)


def column_of(text: Column, at: Column) -> Column:
    """1-based column of an offset, in UTF-16 units."""
    return utf16_length(line_head(text, at)) + 1


def line_window(head: Column, tail: Column, radius: int) -> Column:
    """Up to ``radius`` characters of a line on both sides, given its part before a place and (at least so much of) the text behind,
    with an ellipsis where it is cut."""
    rest = F.substring_index(F.left(tail, F.lit(radius + 2)), "\n", 1)
    body = F.regexp_replace(F.concat(F.right(head, F.lit(radius)), F.left(rest, F.lit(radius))), r"\r\z", "")
    more = lambda full: F.when(F.length(full) > radius, ELLIPSIS).otherwise("")
    return F.concat(more(head), body, more(rest))


_SHOWN = {"\t": "\\t", "\n": "\\n", "\r": "\\r"} | {chr(c): f"<U+{c:04X}>" for c in [*range(9), 11, 12, *range(14, 32), 127]} | {chr(c): f"<{n}>" for c, n in CONTROL_NAMES.items()}
_SPECIAL = r"[\x00-\x1f\x7f\x{00ad}\x{061c}\x{180e}\x{200b}-\x{206f}\x{3164}\x{feff}\x{fe00}-\x{fe0f}\x{E0000}-\x{E01EF}]"


def visualize(text: Column) -> Column:
    """Invisible and control characters spelled out; other text unchanged.  Text without any costs one search."""
    names = constants(_SHOWN)

    def char_form(c):
        code = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
        tag = F.when(code.between(0xE0020, 0xE007E), F.char(code - 0xE0000)).otherwise(F.lower(F.hex(code)))
        number = F.when(code <= 0xFE0F, code - 0xFE00 + 1).otherwise(code - 0xE0100 + 17)
        odd = F.when(code.between(0xE0000, 0xE007F), F.concat(F.lit("<TAG:"), tag, F.lit(">"))).when(code.between(0xFE00, 0xFE0F) | code.between(0xE0100, 0xE01EF), F.concat(F.lit("<VS"), number.cast("string"), F.lit(">")))
        return F.coalesce(F.element_at(names, c), F.when(c > "\u0fff", odd), c)

    return F.when(text.rlike(_SPECIAL), F.array_join(F.transform(F.split(text, ""), char_form), "")).otherwise(text)


def truncate(text: Column, limit: int) -> Column:
    return F.when(utf16_length(text) > limit, F.concat(take(text, limit - 1), F.lit(ELLIPSIS))).otherwise(text)


def flatten(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), r"^ | \z", "")


def preview(text: Column, limit: int) -> Column:
    flat = flatten(text)
    return F.when(utf16_length(flat) > limit, F.concat(take(flat, limit), F.lit("..."))).otherwise(flat)


def fingerprint(rule: Column, path: Column, match: Column) -> Column:
    """16 hexadecimal digits that do not depend on the place of a finding in its file."""
    return F.left(F.sha2(F.concat_ws("\x00", rule, path, F.lower(flatten(match))), 256), F.lit(16))


def code_points(text: Column) -> Column:
    """``U+XXXX`` of each character, joined by a space."""
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.concat(F.lit("U+"), F.lpad(F.regexp_replace(F.hex(F.encode(c, "UTF-32")), "^0+(?=.{4})", ""), 4, "0"))), " ")


def printable_ratio(text: Column) -> Column:
    size = utf16_length(text)
    return F.when(size == 0, 0.0).otherwise(F.length(F.regexp_replace(text, r"[^\t\n\r\x20-\x7e]", "")) / size)


# Fixed value: the words that make a decoded text look like prose.
STOP_WORDS = java(r"\b(?:the|you|and|are|this|that|not|for|with|your|all|any|is|to|do)\b", "i")


def looks_like_prose(text: Column) -> Column:
    return (printable_ratio(text) >= 0.85) & (F.regexp_count(text, F.lit(java(r"\b[a-z]{2,}\b", "i"))) >= 4) & text.rlike(STOP_WORDS)


def extension(basename: Column) -> Column:
    """Lower-cased extension with its dot; a leading dot alone makes none."""
    return F.lower(F.when(basename.rlike(r"^\.?[^.]*\z"), "").otherwise(F.regexp_extract(basename, r"(\.[^.]*)\z", 1)))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
