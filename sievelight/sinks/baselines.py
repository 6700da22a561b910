"""A baseline as a table: accepted findings by fingerprint, merged in Spark, in numbered versions.

``path/v=0000000001`` and so on are Parquet folders.  A version counts once Spark has put its ``_SUCCESS`` there, so readers see the last
whole one; a writer makes the next number and fails if another writer has made it meanwhile.  Equal fingerprints merge by a grouped maximum
of (version, ordinal), which sums up before it is exchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "fingerprint string, rule string, file string, line int, snippet string, note string, version long, ordinal long"
SNIPPET = 200


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions, whole or not, ascending."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def _whole(spark: SparkSession, path: str, version: int) -> bool:
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v={version:010d}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The entries of the last whole version (or of one given); none where there is no baseline."""
    known = [v for v in _versions(spark, path) if _whole(spark, path, v)] if version is None else [version]
    if not known:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(f"{path}/v={known[-1]:010d}")


def entries(findings: DataFrame, note: str | None = None) -> DataFrame:
    """One entry for each fingerprint: of equal ones, that of the last finding in report order."""
    place = F.struct(-F.col("rank"), F.collate("file", "UNICODE"), "file", "line", "column", "rule_ord", "match_ord")
    held = F.struct(F.col("rule_id").alias("rule"), "file", "line", F.left("snippet", F.lit(SNIPPET)).alias("snippet"))
    last = findings.groupBy("fingerprint").agg(F.max_by(held, place).alias("e"))
    return last.select("fingerprint", "e.*", F.lit(note).cast("string").alias("note"))


def merged(old: DataFrame, new: DataFrame, version: int) -> DataFrame:
    """``old`` with ``new(fingerprint, rule, file, line, snippet, note)``; of equal fingerprints the newer counts, and within ``new`` the higher
    ``ordinal``, if it has one."""
    ordinal = F.col("ordinal").cast("long") if "ordinal" in new.columns else F.lit(0).cast("long")
    stamped = new.select("fingerprint", "rule", "file", "line", "snippet", "note", F.lit(version).cast("long").alias("version"), ordinal.alias("ordinal"))
    both = old.unionByName(stamped).where("fingerprint is not null")
    rest = [c for c in both.columns if c != "fingerprint"]
    return both.groupBy("fingerprint").agg(F.max_by(F.struct(*rest), F.struct("version", "ordinal", F.to_json(F.struct(*rest)))).alias("e")).select("fingerprint", "e.*")


def merge(spark: SparkSession, path: str, new: DataFrame) -> int:
    """Writes the next version: the current entries with ``new`` ones; returns its number."""
    taken = _versions(spark, path)
    version = taken[-1] + 1 if taken else 1
    merged(current(spark, path), new, version).write.mode("error").parquet(f"{path}/v={version:010d}")
    return version
