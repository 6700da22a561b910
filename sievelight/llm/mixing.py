"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Documents of a source are shuffled by a digest of doc_id and cut into blocks of ``block`` rows.  A weight is
a whole number of slots out of a period of ``period`` slots.  Block j of a source with quota q may not run
before slot ``floor(j * period / q)`` and must run before slot ``ceil((j + 1) * period / q)``.  Earliest deadline
first over these windows is feasible because the quotas sum to the period, and keeps every source within
one block of its target share in every prefix.  The schedule repeats each period, so one period (a
bounded number of slots, whatever the corpus size) is folded once and joined to the blocks.

No row is dropped or repeated: where a source is used up, its later slots stay empty.  Positions within a
source come from counts of hash buckets, so a source with a third of all rows is numbered by many tasks.

Defined results: a null source is a source of its own; a null doc_id is shuffled first; repeated rows take
places of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick


def temperature_weights(docs: DataFrame, alpha: float = 0.5) -> DataFrame:
    """``(source, weight)`` with weights in proportion to ``rows ** alpha``."""
    return pick(docs, source="string").groupBy("source").agg(F.count("*").alias("n")).select("source", F.pow("n", F.lit(alpha)).alias("weight"))


def quotas(weights: DataFrame, period: int) -> DataFrame:
    """Whole slots of a period for each source: one each, the rest by largest remainder (ties by source)."""
    every = Window.partitionBy(F.lit(1))
    by_rest = every.orderBy(F.desc("rest"), F.col("source").asc_nulls_first())
    share = weights.withColumns({"share": F.col("weight") / F.sum("weight").over(every) * (F.lit(period) - F.count("*").over(every))})
    cut = share.withColumns({"base": F.floor("share") + 1, "rest": F.col("share") - F.floor("share")})
    left = F.lit(period) - F.sum("base").over(every)
    return cut.withColumns({"left": left, "place": F.row_number().over(by_rest)}).select("source", (F.col("base") + (F.col("place") <= F.col("left")).cast("long")).alias("quota"))


def schedule(quota: DataFrame, period: int) -> DataFrame:
    """One period, ``(source, quota, job, slot, release, deadline)``: earliest deadline first, ties by source order."""
    # one row per source is gathered into a single array; its length is the number of sources
    lists = quota.agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), "source", "quota"))).alias("s"))
    fold = f"""
      aggregate(
        sequence(0, {period - 1}),
        named_struct('next', transform(s, x -> 0L), 'out', cast(array() as array<struct<i: int, job: bigint, slot: int>>)),
        (acc, t) -> transform(
          array(array_min(filter(
            transform(s, (x, i) -> named_struct('deadline', ceil((acc.next[i] + 1) * {period}L / x.quota), 'i', i, 'release', floor(acc.next[i] * {period}L / x.quota), 'left', x.quota - acc.next[i])),
            y -> y.left > 0 and y.release <= t))),
          p -> named_struct(
            'next', transform(acc.next, (n, i) -> if(i = p.i, n + 1, n)),
            'out', if(p is null, acc.out, concat(acc.out, array(named_struct('i', p.i, 'job', acc.next[p.i], 'slot', t))))))[0],
        acc -> acc.out)"""
    rows = lists.select("s", F.explode(F.expr(fold)).alias("o")).select(F.col("s")[F.col("o.i")].alias("x"), "o.job", "o.slot")
    q = F.col("x.quota")
    return rows.select("x.source", q.alias("quota"), "job", "slot", F.floor(F.col("job") * period / q).alias("release"), F.ceil((F.col("job") + 1) * period / q).alias("deadline"))


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = 16, period: int = 1000, buckets: int = 256) -> DataFrame:
    """``(doc_id, source, block, place, slot, release, deadline, mix_pos)`` per row of ``docs(doc_id, source)``.

    ``mix_pos`` orders the mixture: slot times block size plus the place in the block.  ``weights(source,
    weight)`` names every source that is to be mixed; by default rows to the power 0.5.  Sources that it
    leaves out get the smallest weight.  With more than ``period / 2`` sources the period is the power of
    two that is at least four times their number, so every source has a slot and weights still decide.
    """
    rows = pick(docs, doc_id="long", source="string").withColumn("digest", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")))
    rows = rows.withColumn("bucket", F.coalesce(F.floor(F.conv(F.substring("digest", 1, 3), 16, 10).cast("int") * buckets / 4096), F.lit(0)))
    sizes = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy("bucket")
    offsets = sizes.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), (F.sum("n").over(ahead) - F.col("n")).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("digest", "doc_id")
    numbered = rows.withColumn("n", F.row_number().over(inside))
    placed = numbered.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    index = F.col("offset") + F.col("n") - 1
    blocks = placed.select("doc_id", "source", F.floor(index / block).alias("block"), F.pmod(index, F.lit(block)).alias("place"))
    present = sizes.select("source").distinct()
    sources = present.count()
    if 2 * sources > period:
        period = 1 << (4 * sources - 1).bit_length()
    given = temperature_weights(docs) if weights is None else pick(weights, source="string", weight="double").where("weight > 0").groupBy("source").agg(F.sum("weight").alias("weight"))
    least = F.min("weight").over(Window.partitionBy(F.lit(1)))
    given = present.join(given.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").select("source", F.coalesce(F.col("weight"), least, F.lit(1.0)).alias("weight"))
    plan = schedule(quotas(given, period), period).withColumnRenamed("source", "_source")
    # the plan has at most ``period`` rows
    both = blocks.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_source")) & (F.pmod(F.col("block"), F.col("quota")) == F.col("job")))
    base = F.floor(F.col("block") / F.col("quota")) * period
    return both.select(
        "doc_id", "source", "block", "place", (base + F.col("slot")).alias("slot"), (base + F.col("release")).alias("release"), (base + F.col("deadline")).alias("deadline"), ((base + F.col("slot")) * block + F.col("place")).alias("mix_pos")
    )
