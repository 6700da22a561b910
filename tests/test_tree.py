"""The distributed listing against the driver's walk."""

import os

import pytest

from sievelight.sources.files import read_files, walk
from sievelight.sources.tree import Filters, read_tree, tree

FILES = {
    "a.md": b"hi", "sub/b.py": b"x", "sub/.gitignore": b"c.*\n!c.md\ndeep/no*\n", "sub/c.py": b"x", "sub/c.md": b"y", "sub/deep/no.md": b"n", "sub/deep/yes.md": b"y", "sub/deep/er/.scanignore": b"*.txt\n",
    "sub/deep/er/x.txt": b"x", "sub/deep/er/y.md": b"y", "node_modules/d.js": b"x", "e.bin": b"x", "empty.md": b"", "big.md": b"z" * 100, "bin.md": b"\x00" * 50 + b"a" * 50, ".cursorrules": b"r", ".git/x.md": b"x",
    "Dockerfile.prod": b"FROM", "é/ü.md": "ä".encode(), ".github/copilot-instructions.md": b"c",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for name, data in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(data)
    (top / "locked").mkdir()
    os.symlink(top, top / "sub/loop")
    os.symlink(top / "sub", top / "é/again")
    os.symlink(top / "nowhere", top / "broken.md")
    os.symlink(top / "a.md", top / "sub/link.md")
    return str(top)


def got(found):
    return sorted((r.path, r.size) for r in found.files.collect()), found.skipped


@pytest.mark.parametrize("options", [{}, {"max_file_size": 99}, {"respect_gitignore": False}, {"default_excludes": False}, {"include": ("*.md",), "exclude": ("big*",)}, {"base": "home", "scoped_exclude": ("home/sub/",)}, {"base": "home", "scoped_include": ("home/**/deep/**",)}])
def test_same_as_walk(spark, root, options):
    want = walk(root, **options)
    found = tree(spark, root, Filters(**options))
    assert got(found) == (sorted((p, n) for p, _, n in want.files), want.skipped)
    assert found.errors.count() == len(want.errors)


def test_links_and_cycles(spark, root):
    found = tree(spark, root, Filters(follow_symlinks=True))
    paths = [p for p, _ in got(found)[0]]
    assert len(paths) == len(set(paths)) and "sub/link.md" in paths and not any(p.startswith(("sub/loop", "é/again")) for p in paths)
    assert not any("loop" in p for p, _, _ in walk(root, follow_symlinks=True).files)


def test_uri_single_file_and_reading(spark, root):
    found = tree(spark, "file://" + root)
    assert got(found)[0] == got(tree(spark, root))[0]
    rows = {r.path: (r.text, r.error) for r in read_tree("file://" + root, found).collect()}
    assert rows == {r.path: (r.text, r.error) for r in read_files(spark, walk(root)).collect()}
    assert rows["é/ü.md"] == ("ä", None) and rows["bin.md"][0] is None
    assert [tuple(r)[0] for r in tree(spark, os.path.join(root, "e.bin")).files.collect()] == ["e.bin"]
    with pytest.raises(FileNotFoundError):
        tree(spark, os.path.join(root, "none"))
    gone = found.files.selectExpr("'gone.md' as path", "concat(absolute, '-gone') as absolute", "size").limit(1)
    (row,) = read_tree(root, type(found)(gone, found.errors, 0)).collect()
    assert row.text is None and row.error
