"""Shared Spark helpers of the pipeline operators: input picking, shared-folder tables, components, membership filters."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import written  # noqa: F401 (for the operators)


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns of ``df``, cast; a missing one is null.

    Columns are found by exact name, so extra columns whose names clash in another case, or that occur
    twice, do no harm (the first exact match counts).
    """
    at = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[(F.col(f"_{at[k]}") if k in at else F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class BlockedBloom:
    """A register-blocked Bloom filter kept as a table: one 64-bit block per row, at most ``max_blocks`` rows.

    A key sets four bits of one block.  The table has two longs a row, so ``max_blocks`` bounds what a
    probe broadcasts (2**17 rows, about 2 MB) however many keys there are; more keys only raise the
    share of false positives, which callers remove by an exact join.
    """

    def __init__(self, keys: DataFrame, column: str, expected: int, max_blocks: int = 1 << 17):
        self.blocks = min(max_blocks, 1 << max(6, math.ceil(math.log2(max(1, expected) / 4))))
        block, mask = self._bits(F.col(column))
        self.table = keys.where(F.col(column).isNotNull()).select(block.alias("_block"), mask.alias("_mask")).groupBy("_block").agg(F.bit_or("_mask").alias("_bits"))

    def _bits(self, key):
        h, g = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
        mask = F.lit(0).cast("long")
        for i in range(4):
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
        return F.pmod(h, F.lit(self.blocks)), mask

    def _probe(self, df: DataFrame, column: str, hit: bool, keep_null: bool = False) -> DataFrame:
        block, mask = self._bits(F.col(column))
        inner = hit and not keep_null
        at, bits, want = (unused(df, x) for x in ("block", "bits", "mask"))
        both = df.withColumns({at: block, want: mask}).join(F.broadcast(self.table.toDF(at, bits)), at, "inner" if inner else "left")
        found = F.coalesce(F.col(bits).bitwiseAND(F.col(want)) == F.col(want), F.lit(False))
        if keep_null:
            found = found | F.col(column).isNull()
        return both.where(found if hit else ~found).select(*df.columns)

    def maybe(self, df: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
        """The rows of ``df`` whose key may be among the filter's keys (or, if asked, is null); none among them is lost."""
        return self._probe(df, column, True, keep_null)

    def surely_not(self, df: DataFrame, column: str) -> DataFrame:
        """The other rows of ``df``."""
        return self._probe(df, column, False)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, component the smallest node.

    Alternating large-star and small-star rounds; each is two grouped minima and joins, and halves the
    depth of the forest.  Nodes without an edge are not listed.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        now = written(joined.select(F.col("m").alias("x"), F.col("a").alias("y")).union(joined.select("m", "b")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a").distinct())


def unused(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, in any case."""
    return f"_{name}_{uuid.uuid4().hex}"


def row_key() -> Column:
    """The key of a row of documents: its id and its text."""
    return F.xxhash64("doc_id", F.xxhash64("text"))


def without(docs: DataFrame, ids: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` whose ``key`` (a long) is not in ``ids(id)``; rows with a null doc_id stay.

    Only rows that a bounded Bloom filter of the ids lets through take part in the join; the texts of all
    others stay in their scan.
    """
    ids = written(ids.where("id is not null").distinct())
    bloom = BlockedBloom(ids, "id", ids.count())
    k, gone = unused(docs, "key"), unused(docs, "gone")
    keyed = docs.withColumn(k, F.when(F.col("doc_id").isNotNull(), key))
    near = bloom.maybe(keyed, k).join(ids.select(F.col("id").alias(gone)), F.col(k) == F.col(gone), "left_anti")
    return bloom.surely_not(keyed, k).unionByName(near).select(*docs.columns)


def one_row_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row (any) of those that share both doc_id and text; rows without a doc_id stay."""
    k = unused(docs, "key")
    keyed = docs.withColumn(k, F.when(F.col("doc_id").isNotNull(), row_key()))
    ids = written(keyed.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("id")).count().where("count > 1").select("id"))
    bloom = BlockedBloom(ids, "id", ids.count())
    near = bloom.maybe(keyed, k).dropDuplicates(["doc_id", "text"])
    return bloom.surely_not(keyed, k).unionByName(near).select(*docs.columns)
