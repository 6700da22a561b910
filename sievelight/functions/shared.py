"""Tables in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH, BATCH_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
PIECE = 1 << 20  # characters


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a local one, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again: its lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sievelight-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB, unless the session sets a size: every worker of every task holds one several times over."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_SIZE)


def gathered(rows: Iterable[tuple[int, object]], kind: pa.DataType) -> pa.Array:
    """The values of ``(size, value)`` as one array; as Python objects there are never more than a piece of them."""
    done, held, size = [], [], 0
    for n, value in rows:
        held.append(value)
        size += n
        if size > PIECE:
            done.append(pa.array(held, kind))
            held, size = [], 0
    return pa.concat_arrays([*done, pa.array(held, kind)])

