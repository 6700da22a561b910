"""Files from directory trees: a driver-side walk of names, then Spark tasks that read the bytes.

Names are filtered before any byte is read: excludes, scoped excludes, ignore files, text test, includes, size.  Symbolic links and
dot files need the walk itself, which Spark's listing leaves out.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import GlobSet

# Default excludes, text extensions and names, binary thresholds, sizes.
DEFAULT_EXCLUDES = [
    ".git/", ".hg/", ".svn/", "node_modules/", "bower_components/", "vendor/", "dist/", "build/", "out/", "target/", ".next/", ".nuxt/",
    ".svelte-kit/", ".turbo/", ".parcel-cache/", ".cache/", "__pycache__/", ".venv/", "venv/", ".tox/", ".mypy_cache/", ".pytest_cache/", ".gradle/",
    ".idea/", "Pods/", "coverage/", ".nyc_output/", "*.min.js", "*.min.css", "*.map", "*.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "Cargo.lock", "poetry.lock", "composer.lock", "go.sum",
]
TEXT_EXTENSIONS = {
    ".md", ".mdx", ".markdown", ".rst", ".txt", ".adoc", ".asciidoc", ".org", ".json", ".jsonc", ".json5", ".yaml", ".yml", ".toml", ".ini", ".cfg",
    ".conf", ".properties", ".env", ".editorconfig", ".xml", ".plist", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts", ".vue",
    ".svelte", ".astro", ".py", ".pyi", ".rb", ".go", ".rs", ".java", ".kt", ".kts", ".scala", ".c", ".h", ".cc", ".cpp", ".hpp", ".cxx", ".hh",
    ".m", ".mm", ".cs", ".fs", ".swift", ".php", ".pl", ".pm", ".lua", ".r", ".jl", ".dart", ".ex", ".exs", ".erl", ".hrl", ".clj", ".cljs", ".hs",
    ".elm", ".zig", ".nim", ".v", ".sol", ".sh", ".bash", ".zsh", ".fish", ".ps1", ".psm1", ".bat", ".cmd", ".mk", ".cmake", ".gradle", ".sbt",
    ".bzl", ".html", ".htm", ".css", ".scss", ".sass", ".less", ".graphql", ".gql", ".sql", ".proto", ".tf", ".tfvars", ".hcl", ".dockerfile",
    ".ipynb",
}
IGNORE_FILES = (".gitignore", ".scanignore")
TEXT_NAMES = {
    "Dockerfile", "Makefile", "Rakefile", "Gemfile", "Procfile", "Brewfile", "Jenkinsfile", "Vagrantfile", "CODEOWNERS", "LICENSE", "NOTICE",
    "README", "CHANGELOG", "AUTHORS", "CONTRIBUTING", "AGENTS", "AGENTS.md", ".gitignore", ".gitattributes", ".npmrc", ".nvmrc", ".babelrc",
    ".eslintrc", ".prettierrc", ".cursorrules", ".windsurfrules", ".clinerules", ".aiderignore", ".scanignore",
}
MAX_FILE_SIZE = 2 * 1024 * 1024
HEAD, NULL_SHARE, CONTROL_SHARE = 8192, 0.02, 0.1


@dataclass
class Walk:
    files: list[tuple[str, str, int]] = field(default_factory=list)  # (path below the root, absolute path, size)
    skipped: int = 0
    errors: list[tuple[str, str]] = field(default_factory=list)


def is_text_name(name: str) -> bool:
    ext = os.path.splitext(name)[1].lower()
    stem = name.split(".")[0]
    return ext in TEXT_EXTENSIONS or name in TEXT_NAMES or (stem != "" and stem in TEXT_NAMES) or (name.startswith(".") and not ext)


def walk(root: str, exclude=(), include=(), scoped_exclude=(), scoped_include=(), base: str = "", default_excludes: bool = True, respect_gitignore: bool = True, max_file_size: int = MAX_FILE_SIZE, follow_symlinks: bool = False) -> Walk:
    """Scannable files below ``root``; a file as root is taken as it is.  ``base`` is the root's place below the folder that scoped globs refer to."""
    out = Walk()
    if os.path.isfile(root):
        out.files.append((os.path.basename(root), os.path.abspath(root), os.path.getsize(root)))
        return out
    excludes = GlobSet([*(DEFAULT_EXCLUDES if default_excludes else ()), *exclude])
    wanted, far_excludes, far_wanted = GlobSet(include), GlobSet(scoped_exclude), GlobSet(scoped_include)
    seen = {os.path.realpath(root)}
    stack: list[tuple[str, list]] = [("", [])]
    while stack:
        folder, ignores = stack.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError as e:
            out.errors.append((folder or ".", str(e)))
            continue
        if respect_gitignore:
            lines = [x for n in IGNORE_FILES for x in _lines(os.path.join(root, folder, n))]
            ignores = [*ignores, (len(folder) + 1 if folder else 0, GlobSet(lines))] if lines else ignores
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_symlink() and not follow_symlinks:
                continue
            is_dir, is_file = e.is_dir(), e.is_file()
            if not is_dir and not is_file:
                continue
            far = f"{base}/{path}" if base else path
            if excludes.matches(path, is_dir) or far_excludes.matches(far, is_dir) or any(s.matches(path[cut:], is_dir) for cut, s in ignores):
                out.skipped += 1
            elif is_dir:
                real = os.path.realpath(e.path)
                if not follow_symlinks or real not in seen:
                    seen.add(real)
                    stack.append((path, ignores))
            elif not is_text_name(e.name) or (len(wanted) and not wanted.matches(path)) or (len(far_wanted) and not far_wanted.matches(far)):
                out.skipped += 1
            else:
                size = e.stat().st_size
                if 0 < size <= max_file_size:
                    out.files.append((path, os.path.abspath(e.path), size))
                else:
                    out.skipped += 1
    out.files.sort()
    return out


def _lines(path: str) -> list[str]:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read().splitlines()
    except OSError:
        return []


def control_bytes(data: bytes) -> tuple[int, int]:
    """NUL bytes and other control bytes among the first bytes of a file."""
    head = data[:HEAD]
    return head.count(0), sum(head.count(c) for c in range(1, 32) if c not in (9, 10, 13))


def looks_binary(data: bytes) -> bool:
    """By density, so that one planted NUL does not hide a text."""
    size = min(len(data), HEAD)
    null, control = control_bytes(data)
    return size > 0 and (null / size > NULL_SHARE or (null + control) / size > CONTROL_SHARE)


def _read(batches):
    for pdf in batches:
        rows = []
        for path, absolute in zip(pdf.path, pdf.absolute, strict=True):
            try:
                with open(absolute, "rb") as f:
                    data = f.read()
            except OSError as e:
                rows.append((path, None, str(e)))
                continue
            binary = looks_binary(data)
            rows.append((path, None if binary else data.decode("utf-8", "replace"), "text extension but binary content; not scanned" if binary else None))
        yield pd.DataFrame(rows, columns=["path", "text", "error"])


def read_files(spark: SparkSession, found: Walk, concurrency: int = 16) -> DataFrame:
    """``(path, text, error)`` of walked files; tasks need the same file system as the driver."""
    schema = "path string, absolute string, size long"
    listed = spark.createDataFrame(found.files, schema) if found.files else spark.createDataFrame([], schema)
    parts = max(1, min(concurrency, len(found.files)))
    return listed.repartition(parts, F.xxhash64("path")).mapInPandas(_read, "path string, text string, error string")
