"""The corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents``; it works on all rows its predecessor kept.
Rows with a null doc_id pass the filtering stages, as no decision can name them.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.common import one_row_each, row_key, unused, without, written
from sievelight.llm.language_id import identify
from sievelight.llm.mixing import mix
from sievelight.llm.near_dedup import near_duplicates
from sievelight.llm.sentencepiece_sampling import encode_documents
from sievelight.llm.substring_dedup import strip_texts


KNOWN = ("doc_id", "text", "lang", "source", "n_chars")
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB, unless the session sets a size: each is held several times over, by the JVM and by a worker, in every task."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, "8m")


def _apart(stage):
    """Inside a stage, all but the known columns have names of their own, so that none can clash."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _small_batches(spark)
        names = docs.columns
        inner = [n if n in KNOWN and names.index(n) == j else f"other_{j}" for j, n in enumerate(names)]
        return stage(spark, docs.toDF(*inner), sf_dir).toDF(*names)

    return run


@_apart
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language stays unclear (best posterior under one half) go."""
    found = identify(docs, spark.read.parquet(f"{sf_dir}/pages.parquet"), keyed=True)
    return without(docs, found.where("rejected and doc_id is not null").select(F.col("row_key").alias("id")), row_key())


@_apart
def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more) stays, that with the smallest doc_id.

    Of rows that share doc_id and text one stays; different texts under one doc_id are judged apart.
    """
    found = near_duplicates(docs, percent=80, keyed=True)
    return one_row_each(without(docs, found.where("not kept").select(F.col("row_key").alias("id")), row_key()))


@_apart
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that stand in an earlier document go; a document left without a word goes too."""
    cut = strip_texts(docs, size=20)
    cut = cut if "n_chars" not in docs.columns else cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.where("n_removed = 0 or n_left > 0").select(*docs.columns)


def _places(docs: DataFrame) -> DataFrame:
    """``(_id, mix_pos)``: the place of each doc_id in the mixture."""
    places = mix(docs, block=16, period=1000).select(F.col("doc_id").alias("_id"), "mix_pos")
    return places.groupBy("_id").agg(F.min("mix_pos").alias("mix_pos"))


@_apart
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: source weights in proportion to the root of their sizes.

    Rows that share a doc_id stand together, at the first of their places; a null source is a source of its own; an empty table gives none.
    """
    doc, pos = unused(docs, "id"), unused(docs, "pos")
    placed = docs.join(_places(docs).toDF(doc, pos), F.col("doc_id").eqNullSafe(F.col(doc)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(parts, pos).sortWithinPartitions(pos).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of all texts, each checked to decode to its text, and their places in the mixture.

    A null or empty text has no pieces; repeated rows are all returned; an empty table gives none.
    """
    _small_batches(spark)
    encoded = encode_documents(docs, alpha=1.0, seed=8)
    return encoded.join(_places(docs), F.col("doc_id").eqNullSafe(F.col("_id"))).select(*encoded.columns, "mix_pos")


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicate),
    ("substring_dedup", repeated_passages),
    ("mixing", mixture),
    ("sentencepiece", pieces),
]
#: Signatures, sampled segmentations and the language model are not expressible in SQL; tests/llm checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
