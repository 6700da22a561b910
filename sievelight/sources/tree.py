"""Listing a directory tree level by level in tasks, and reading its files, on any file system that pyarrow knows.

Each row of a level is a folder with the ignore files it inherits; a task lists it and gives back its files, its folders (the next level),
what was left out and what could not be read.  The driver sees counts only.  A level is one Spark job, written to the shared folder, so a lost executor
repeats no earlier level.  With followed links, a folder whose real path was listed before, or is listed elsewhere on the same level under a smaller
path, is left out: that ends cycles.  Local links are told by the operating system; other file systems have none.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import GlobSet
from ..functions.shared import written
from .files import DEFAULT_EXCLUDES, IGNORE_FILES, MAX_FILE_SIZE, is_text_name, looks_binary

FOLDER = "path string, real string, ignores array<struct<cut: int, lines: array<string>>>"
ENTRY = f"kind string, {FOLDER}, absolute string, size long, message string, skipped long"


def _system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))


@dataclass
class Tree:
    """``files(path, absolute, size)``, ``errors(file, message)``, and how many entries were skipped."""

    files: DataFrame
    errors: DataFrame
    skipped: int


@dataclass(frozen=True)
class Filters:
    """What a walk takes, as in :func:`.files.walk`."""

    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    scoped_exclude: tuple[str, ...] = ()
    scoped_include: tuple[str, ...] = ()
    base: str = ""
    default_excludes: bool = True
    respect_gitignore: bool = True
    max_file_size: int = MAX_FILE_SIZE
    follow_symlinks: bool = False


def _entries(system: fs.FileSystem, folder: str, local: bool, follow: bool):
    """``(name, whole path, is folder, size, real path)`` of what a folder holds; links and other things as the walk wants them."""
    if local:
        for e in os.scandir(folder):
            if e.is_symlink() and not follow or not (e.is_dir() or e.is_file()):
                continue
            is_dir = e.is_dir()
            yield e.name, e.path, is_dir, None if is_dir else e.stat().st_size, os.path.realpath(e.path) if is_dir and follow else e.path
        return
    for i in system.get_file_info(fs.FileSelector(folder)):
        if i.type in (fs.FileType.Directory, fs.FileType.File):
            yield i.base_name, i.path, i.type == fs.FileType.Directory, i.size, i.path


def _lines(system: fs.FileSystem, path: str) -> list[str]:
    if system.get_file_info(path).type != fs.FileType.File:
        return []
    with system.open_input_stream(path) as f:
        return f.read().decode("utf-8", "replace").splitlines()


def _lister(root: str, filters: Filters):
    def run(batches):
        system, top = _system(root)
        local = isinstance(system, fs.LocalFileSystem)
        excludes = GlobSet([*(DEFAULT_EXCLUDES if filters.default_excludes else ()), *filters.exclude])
        wanted, far_excludes, far_wanted = GlobSet(filters.include), GlobSet(filters.scoped_exclude), GlobSet(filters.scoped_include)
        for pdf in batches:
            rows = []
            for folder, inherited in zip(pdf.path, pdf.ignores, strict=True):
                whole, skipped = f"{top}/{folder}" if folder else top, 0
                ignores = [{"cut": int(i["cut"]), "lines": list(i["lines"])} for i in inherited]
                try:
                    entries = sorted(_entries(system, whole, local, filters.follow_symlinks))
                    if filters.respect_gitignore and (lines := [x for n in IGNORE_FILES for x in _lines(system, f"{whole}/{n}")]):
                        ignores.append({"cut": len(folder) + 1 if folder else 0, "lines": lines})
                except OSError as e:
                    rows.append(("error", folder or ".", None, None, None, None, str(e), 0))
                    continue
                held = [(i["cut"], GlobSet(i["lines"])) for i in ignores]
                for name, absolute, is_dir, size, real in entries:
                    path = f"{folder}/{name}" if folder else name
                    far = f"{filters.base}/{path}" if filters.base else path
                    if excludes.matches(path, is_dir) or far_excludes.matches(far, is_dir) or any(s.matches(path[cut:], is_dir) for cut, s in held):
                        skipped += 1
                    elif is_dir:
                        rows.append(("folder", path, real, ignores, absolute, None, None, 0))
                    elif not is_text_name(name) or len(wanted) and not wanted.matches(path) or len(far_wanted) and not far_wanted.matches(far) or not 0 < size <= filters.max_file_size:
                        skipped += 1
                    else:
                        rows.append(("file", path, None, None, absolute, size, None, 0))
                rows.append(("skipped", folder, None, None, None, None, None, skipped))
            out = pd.DataFrame(rows, columns=["kind", "path", "real", "ignores", "absolute", "size", "message", "skipped"])
            yield out.astype({"size": "Int64"})

    return run


def tree(spark: SparkSession, root: str, filters: Filters = Filters(), tasks: int | None = None) -> Tree:
    """The scannable files below ``root`` (a path or URI that driver and executors share), as :func:`.files.walk` finds them."""
    system, top = _system(root)
    info = system.get_file_info(top)
    none = spark.createDataFrame([], "file string, message string")
    if info.type == fs.FileType.File:
        return Tree(spark.createDataFrame([(os.path.basename(top), top, info.size)], "path string, absolute string, size long"), none, 0)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = os.path.realpath(top) if isinstance(system, fs.LocalFileSystem) else top
    level, levels, seen = spark.createDataFrame([("", first, [])], FOLDER), [], None
    while True:
        listed = written(level.repartition(tasks, "path").mapInPandas(_lister(root, filters), ENTRY))
        levels.append(listed)
        folders = listed.where("kind = 'folder'").select("path", "real", "ignores")
        if filters.follow_symlinks:
            seen = level.select("real") if seen is None else seen.unionByName(level.select("real"))
            folders = folders.groupBy("real").agg(F.min_by(F.struct("path", "ignores"), "path").alias("f")).select("f.path", "real", "f.ignores").join(seen, "real", "left_anti")
            folders = written(folders.select("path", "real", "ignores"))
        if folders.isEmpty():
            break
        level = folders
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    skipped = every.agg(F.coalesce(F.sum("skipped"), F.lit(0))).first()[0]
    files = every.where("kind = 'file'").select("path", "absolute", "size")
    return Tree(files, every.where("kind = 'error'").select(F.col("path").alias("file"), "message"), skipped)


def _reader(root: str):
    def run(batches):
        system, _ = _system(root)
        for pdf in batches:
            for path, absolute in zip(pdf.path, pdf.absolute, strict=True):
                try:
                    with system.open_input_stream(absolute) as f:
                        data = f.read()
                except OSError as e:
                    row = (path, None, str(e))
                else:
                    binary = looks_binary(data)
                    row = (path, None if binary else data.decode("utf-8", "replace"), "text extension but binary content; not scanned" if binary else None)
                yield pd.DataFrame([row], columns=["path", "text", "error"])

    return run


def read_tree(root: str, found: Tree, tasks: int | None = None) -> DataFrame:
    """``(path, text, error)`` of the files of a tree, dealt by their size so that tasks read about as much."""
    spark = found.files.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return found.files.repartition(tasks, F.xxhash64("path")).mapInPandas(_reader(root), "path string, text string, error string")
