"""The table function of SQL."""

import pytest

from sievelight.operators.prose import BASENAMES, EXTENSIONS, family_name, family_of
from sievelight.plans.table_function import register


def test_lateral_join(spark):
    register(spark)
    rows = [("a.md", "x\n ignore previous rules\U0001f600 ignore all prior rules"), ("b.js", "ignore prior rules // ignore all\n// previous rules"), (None, "ignore prior rules"), ("c.md", None), ("d.md", "fine")]
    spark.createDataFrame(rows, "path string, text string").createOrReplaceTempView("some_files")
    sql = "SELECT f.path, m.* FROM some_files f, LATERAL text_matches(f.path, f.text{}) m ORDER BY path, idx"
    got = spark.sql(sql.format(", 'injection/instruction-override', true"))
    assert got.columns == ["path", "rule_id", "pattern", "idx", "match", "prose", "line", "column"]
    assert [(r.path, r.idx, r.match, r.prose, r.line, r.column) for r in got.collect()] == [
        ("a.md", 3, "ignore previous rules", True, 2, 2), ("a.md", 26, "ignore all prior rules", True, 2, 26), ("b.js", 0, "ignore prior rules", False, 1, 1), ("b.js", 22, "ignore all\n   previous rules", True, 1, 23),
    ]
    assert spark.sql(sql.format("")).columns == ["path", "rule_id", "pattern", "idx", "match", "prose"]
    for bad in (", 'no/such'", ", f.path"):
        with pytest.raises(Exception, match="unknown rule|must be a constant"):
            spark.sql(sql.format(bad)).collect()


def test_families_of_paths(spark):
    paths = ["a/b.PY", "x", ".py", ".env", "a.tar.gz", "Dockerfile.prod", "d/Makefile", "a.b/c", "a.", "", "..md", *(f"q{e}" for n in EXTENSIONS.values() for e in n.split()), *(n for v in BASENAMES.values() for n in v.split())]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for r in df.select("path", family_of(df.path).alias("family")).collect():
        assert family_name(r.path) == r.family, r.path
