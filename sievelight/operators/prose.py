"""Where a file holds language: comments, strings and whole-text documents; and the comment normaliser.

Whole-text documents are decided by Spark expressions alone.  Code goes through one Arrow function that
tokenises each text with a single linear regular expression of its language family.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import gathered, small_batches
from ..functions.text import basename, constants, extension

# Language families as (line comments, block comments, strings); a triple-quoted or back-quoted string spans lines.
FAMILIES = {
    "document": ((), (("<!--", "-->"),), ()),
    "c": (("//",), (("/*", "*/"),), ("`", '"', "'")),
    "hash": (("#",), (), ('"', "'")),
    "python": (("#",), (), ('"""', "'''", '"', "'")),
    "markup": ((), (("<!--", "-->"),), ('"', "'")),
    "json": (("//",), (("/*", "*/"),), ('"',)),
    "sql": (("--",), (("/*", "*/"),), ("'", '"')),
    "lisp": ((";",), (), ('"',)),
    "ini": (("#", ";"), (), ('"', "'")),
    "php": (("//", "#"), (("/*", "*/"),), ('"', "'")),
    "css": ((), (("/*", "*/"),), ('"', "'")),
    "lua": (("--",), (("--[[", "]]"),), ('"', "'")),
    "haskell": (("--",), (("{-", "-}"),), ('"',)),
    "erlang": (("%",), (), ('"',)),
    "powershell": (("#",), (("<#", "#>"),), ('"', "'")),
    "batch": (("REM ", "::"), (), ('"',)),
}
EXTENSIONS = {
    "document": ".md .mdx .markdown .txt .rst .adoc .asciidoc .org",
    "markup": ".html .htm .xml .svg .vue .svelte .astro .plist",
    "json": ".json .jsonc .json5 .ipynb",
    "hash": ".yaml .yml .toml .cfg .conf .properties .env .editorconfig .graphql .gql .tf .tfvars .hcl .rb .pl .pm .r .jl .ex .exs .nim .sh .bash .zsh .fish .mk .cmake .bzl .dockerfile",
    "ini": ".ini",
    "c": ".js .jsx .mjs .cjs .ts .tsx .mts .cts .java .kt .kts .scala .c .h .cc .cpp .hpp .cxx .hh .m .mm .cs .go .rs .swift .dart .zig .sol .v .scss .sass .less .proto .gradle .sbt .fs",
    "php": ".php", "css": ".css", "python": ".py .pyi", "sql": ".sql", "lua": ".lua", "haskell": ".hs .elm", "erlang": ".erl .hrl",
    "lisp": ".clj .cljs", "powershell": ".ps1 .psm1", "batch": ".bat .cmd",
}
BASENAMES = {"c": "Jenkinsfile", "hash": "Dockerfile Makefile Rakefile Gemfile Procfile Brewfile Vagrantfile CODEOWNERS .gitignore .gitattributes .npmrc .nvmrc"}
AGENT_FILES = [
    "claude.md", "agents.md", "agent.md", ".cursorrules", ".windsurfrules", ".clinerules", ".roorules", ".aiderrules", "copilot-instructions.md",
    "gemini.md", "qwen.md", ".github/copilot-instructions.md", ".mcp.json", ".aider.conf.yml", "codex.md",
]
AGENT_FOLDERS = r"(^|/)\.(claude|cursor|codex|windsurf|continue|cline|aider)/|(^|/)\.github/(copilot|chatmodes|prompts|instructions)"
BLANK = r"[ \t\x0b\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
GAP = re.compile(rf"{BLANK}*+\n?+{BLANK}*+(?://|#++|--|;++|%|\*|REM|::)?+{BLANK}*+")
CONTINUED = re.compile(rf"(\n{BLANK}*+)(//+|#+|--+|;+|\*+|>+|%)")

_BY_EXTENSION = {e: family for family, names in EXTENSIONS.items() for e in names.split()}
_BY_NAME = {n: family for family, names in BASENAMES.items() for n in names.split()}


def family_of(path: Column) -> Column:
    """The language family of a path: by exact name, then ``Dockerfile*``, then extension, else a document."""
    name = basename(path)
    by_name, by_extension = F.element_at(constants(_BY_NAME), name), F.element_at(constants(_BY_EXTENSION), extension(name))
    return F.coalesce(by_name, F.when(name.startswith("Dockerfile"), "hash"), by_extension, F.lit("document"))


def family_name(path: str) -> str:
    """:func:`family_of` of one path."""
    name = path.rsplit("/", 1)[-1]
    by_extension = _BY_EXTENSION.get("." + name.rsplit(".", 1)[1].lower(), "document") if "." in name[1:] else "document"
    return _BY_NAME.get(name) or ("hash" if name.startswith("Dockerfile") else by_extension)


def is_agent_file(path: Column) -> Column:
    low = F.lower(path)
    return F.coalesce(basename(low).isin(AGENT_FILES) | low.isin(AGENT_FILES) | low.rlike(AGENT_FOLDERS), F.lit(False))


@lru_cache
def lexer(family: str) -> re.Pattern:
    """One alternation, longest opener first (blocks, lines, strings among equals); the named group holds the content."""
    lines, blocks, strings = FAMILIES[family]
    parts = [(o, rf"{re.escape(o)}(?P<c{i}>(?:(?!{re.escape(c)})[\s\S])*+)(?:{re.escape(c)})?") for i, (o, c) in enumerate(blocks)]
    parts += [(o, rf"{re.escape(o)}(?P<l{i}>[^\n]*+)") for i, o in enumerate(lines)]
    for i, q in enumerate(strings):
        stop = r"\\" if q == "`" or len(q) == 3 else r"\\\n"
        ahead = rf"(?!{q})" if len(q) == 3 else ""
        body = f"[^{stop}]" if len(q) == 3 else f"[^{stop}{q}]"
        parts.append((q, rf"{q}(?P<s{i}>(?:\\[\s\S]?|{ahead}{body})*+)(?:{q})?"))
    return re.compile("|".join(p for _, p in sorted(parts, key=lambda x: -len(x[0]))))


def spans(text: str, family: str) -> list[tuple[int, int, str]]:
    """Prose spans ``(start, end, kind)`` of a code text; neighbouring comments of one run are one span."""
    out: list[tuple[int, int, str]] = []
    for m in lexer(family).finditer(text):
        start, end = m.span(m.lastgroup)
        if end <= start:
            continue
        kind = "string" if m.lastgroup[0] == "s" else "comment"
        if out and out[-1][2] == kind:
            gap = text[out[-1][1] : start]
            if gap == "" or kind == "comment" and GAP.fullmatch(gap):
                out[-1] = (out[-1][0], end, kind)
                continue
        out.append((start, end, kind))
    return out


def normalise(text: str, found: list[tuple[int, int, str]]) -> str:
    """Comment openers that continue a comment on the next line become spaces; lengths stay."""
    parts, at = [], 0
    for start, end, kind in found:
        if kind == "comment" and "\n" in text[start:end]:
            parts += [text[at:start], CONTINUED.sub(lambda m: m[1] + " " * len(m[2]), text[start:end])]
            at = end
    return "".join([*parts, text[at:]])


SPANS = "array<struct<start: int, end: int, kind: string>>"
SPANS_KIND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def lexed(text: str, family: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The text that rules see, and its spans; a whole-text document needs none."""
    found = [] if family == "document" else spans(text, family)
    return normalise(text, found), found


def as_spans(found: list[tuple[int, int, str]]) -> list[dict]:
    return [{"start": s, "end": e, "kind": k} for s, e, k in found]


def _lexed(text: Column, family: Column) -> Column:
    """``struct<text, spans>`` of a code text; no text where rules see it as it is."""
    kind = pa.struct([("text", pa.string()), ("spans", SPANS_KIND)])

    def one(t: str | None, f: str) -> tuple[int, dict]:
        seen, found = lexed(t, f) if t is not None else (None, [])
        return len(t or ""), {"text": seen if seen != t else None, "spans": as_spans(found)}

    def run(text: pa.Array, family: pa.Array) -> pa.Array:
        return gathered((one(t.as_py(), f.as_py()) for t, f in zip(text, family, strict=True)), kind)

    # a filter or a generator above would have a deterministic function run once more
    return F.arrow_udf(run, f"struct<text: string, spans: {SPANS}>").asNondeterministic()(text, family)


def kinds_of_files(files: DataFrame) -> DataFrame:
    """``files(path, text)`` with ``family, whole, agent_file``."""
    out = files.withColumn("family", family_of(F.col("path")))
    return out.select("*", (F.col("family") == "document").alias("whole"), is_agent_file(F.col("path")).alias("agent_file"))


def spans_of(whole: Column, text: Column, found: Column) -> Column:
    """A document's one span, or those found in code."""
    one = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), F.lit("document").alias("kind")))
    return F.when(whole, one).otherwise(F.coalesce(found, F.array().cast(SPANS)))


def prepare(files: DataFrame) -> DataFrame:
    """``files(path, text)`` with ``family, whole, rule_text, spans, agent_file``; other columns stay."""
    small_batches(files.sparkSession)
    out = kinds_of_files(files)
    out = out.withColumn("_lexed", _lexed(F.when(~F.col("whole"), F.col("text")), F.col("family")))
    return out.select(*files.columns, "family", "whole", F.coalesce("_lexed.text", "text").alias("rule_text"), spans_of(F.col("whole"), F.col("text"), F.col("_lexed.spans")).alias("spans"), "agent_file")
