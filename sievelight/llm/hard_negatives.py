"""Hard negatives for contrastive training: exact integer scores by Kronecker-packed products.

1.  Each component x of a vector becomes floor(scale * x).  Rows are grouped into ``anchors`` (ids divisible by ``every``) and candidates (all).
2.  Anchors are dealt into blocks of at most ``block`` by a hash, candidates into as many shares as the job has tasks for a block.  One
    exchange brings each share to each block, sorted so that a task sees the block's anchors first and then streams the candidates; it holds
    the anchors, one batch of candidates and the best found so far.
3.  Scores come from packed products.  The components of several candidates, made nonnegative by a bias, stand in separate fields
    of one wide integer; one multiplication by an anchor's component serves them all, and the fields of the sum over the components, made nonnegative
    by half a field's width, are the exact scores.  A field is as wide as the largest sum of the given table asks for.  As long as a packed sum stays
    below 2**52, wide integers are held in doubles, so the products are matrix products and exact; wider ones are Python integers.
4.  The first pass keeps an anchor's best rows of its label, the second, which knows their scores, its best other rows within each
    positive's window.  Per task and anchor only a few rows go on to be merged.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component take no part, nor do those of another length than the
most common one (the shorter of equally common ones), nor those with a component of 2**31 / sqrt(length) or more after scaling, whose scores may not fit 64
bits.  Copies of a row (same vec_id, label, vector) count once; different rows that share a vec_id are rows of their own, in the order of a hash of label
and vector among equal scores.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

HELD = 52  # bits of a packed sum that doubles hold exactly, sign aside
NONE = -(1 << 62)


class Fields:
    """How candidates are packed: ``count`` fields of ``width`` bits, components raised by ``bias``."""

    def __init__(self, low: int, high: int, reach: int):
        """Components lie in low..high; reach: the largest sum of an anchor's absolute components."""
        self.bias = -low
        self.width = 1 + (reach * max(high - low, 1)).bit_length()
        self.exact = self.width <= HELD
        self.count = HELD // self.width if self.exact else 4
        self.half = 1 << self.width - 1
        self.halves = sum(self.half << self.width * f for f in range(self.count))
        most = reach * max(abs(low), abs(high))
        self.kind = np.int64 if most < 1 << 46 else object  # of the scores; with room for a batch's positions

    def pack(self, x: np.ndarray) -> np.ndarray:
        """``(wide integers, dims)`` of the rows of ``x``; the last one may have empty fields."""
        rows = -(-len(x) // self.count)
        raised = np.full((rows * self.count, x.shape[1]), self.bias, object if not self.exact else np.int64)
        raised[: len(x)] = x.astype(raised.dtype) + self.bias
        raised = raised.reshape(rows, self.count, -1)
        out = raised[:, 0].copy()
        for f in range(1, self.count):
            out += raised[:, f] << self.width * f
        return out.astype(np.float64) if self.exact else out

    def scores(self, anchors: np.ndarray, packed: np.ndarray, n: int) -> np.ndarray:
        """Inner products of the rows of ``anchors`` with the ``n`` packed candidates."""
        if self.exact:
            total = (anchors.astype(np.float64) @ packed.T).astype(np.int64)
        else:
            total = anchors.astype(object) @ packed.T
        total = total + self.halves
        out = np.empty((*total.shape, self.count), total.dtype)
        for f in range(self.count):
            out[:, :, f] = (total >> self.width * f) & (2 * self.half - 1)
        shift = self.half + self.bias * anchors.astype(total.dtype).sum(axis=1)
        return (out.reshape(len(anchors), -1)[:, :n] - shift[:, None]).astype(self.kind)


class Best:
    """The k best rows of each of some lists: highest score first, then by (vec_id, tie)."""

    def __init__(self, lists: int, k: int, kind):
        self.k = k
        self.score = np.full((lists, k), NONE, kind)
        self.vec = np.zeros((lists, k), np.int64)
        self.tie = np.zeros((lists, k), np.int64)

    def add(self, lists: np.ndarray, scores: np.ndarray, allowed: np.ndarray, vec: np.ndarray, tie: np.ndarray) -> None:
        """A batch of candidates, in order of (vec, tie), for some of the lists."""
        n = scores.shape[1]
        # a list whose worst kept score no candidate reaches keeps what it has
        open_ = allowed & (scores >= self.score[lists, -1][:, None])
        some = open_.any(axis=1)
        if not some.any():
            return
        lists, scores, open_ = lists[some], scores[some], open_[some]
        place = np.where(open_, scores * n + np.arange(n - 1, -1, -1), NONE)
        k = min(self.k, n)
        at = np.argpartition(-place, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), place.shape)
        fine = np.take_along_axis(open_, at, axis=1)
        score = np.where(fine, np.take_along_axis(scores, at, axis=1), NONE)
        score = np.concatenate([self.score[lists], score], axis=1)
        vec_, tie_ = np.concatenate([self.vec[lists], vec[at]], axis=1), np.concatenate([self.tie[lists], tie[at]], axis=1)
        order = _order(score, vec_, tie_)[:, : self.k]
        self.score[lists], self.vec[lists], self.tie[lists] = (np.take_along_axis(x, order, axis=1) for x in (score, vec_, tie_))


def _order(score: np.ndarray, vec: np.ndarray, tie: np.ndarray) -> np.ndarray:
    order = np.argsort(tie, axis=1, kind="stable")
    order = np.take_along_axis(order, np.argsort(np.take_along_axis(vec, order, axis=1), axis=1, kind="stable"), axis=1)
    return np.take_along_axis(order, np.argsort(np.take_along_axis(-score, order, axis=1), axis=1, kind="stable"), axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _streamed(fields: Fields, width: int, k: int, windows: int, least: int, most: int, step: int = 128, batch_rows: int = 4096):
    """Scores the candidates of each (block, share) against the block's anchors and yields each list's best.

    ``windows`` 0: one list an anchor, rows of its label but itself; otherwise one list for each of its positives, rows of other labels
    with least * positive <= 100 * score <= most * positive.
    """

    def run(batches):
        key, parts, state = None, [], None

        def ready():
            table = pa.Table.from_batches(parts).combine_chunks()
            x = _matrix(table.column("x").combine_chunks(), width)
            column = {c: table.column(c).to_numpy() for c in ("vec_id", "tie", "label")}
            lists = np.arange(len(x)) if not windows else None
            if windows:
                held = table.column("positives").combine_chunks()
                sizes = np.diff(held.offsets.to_numpy())
                column["positive"] = held.flatten().to_numpy(zero_copy_only=False).astype(fields.kind)
                owner = np.repeat(np.arange(len(x)), sizes)
                return x, column, owner, Best(len(owner), k, fields.kind)
            return x, column, lists, Best(len(x), k, fields.kind)

        def out():
            x, column, owner, best = state
            at, place = np.nonzero(best.score > NONE)
            values = {"anchor": column["vec_id"][owner[at]], "anchor_tie": column["tie"][owner[at]], "vec": best.vec[at, place], "tie": best.tie[at, place], "score": best.score[at, place]}
            if windows:
                first = np.searchsorted(owner, np.arange(len(x)))
                values["positive"] = (np.arange(len(owner)) - first[owner])[at]
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in values.values()], names=list(values))

        def add(batch):
            x, column, owner, best = state
            c = _matrix(batch.column("x"), width)
            vec, tie, label = (batch.column(n).to_numpy() for n in ("vec_id", "tie", "label"))
            packed = fields.pack(c)
            for s in range(0, len(x), step):
                rows = slice(s, min(s + step, len(x)))
                scores = fields.scores(x[rows], packed, len(c))
                same = column["label"][rows][:, None] == label
                if not windows:
                    itself = (column["vec_id"][rows][:, None] == vec) & (column["tie"][rows][:, None] == tie)
                    best.add(np.arange(rows.start, rows.stop), scores, same & ~itself, vec, tie)
                    continue
                lists = np.arange(*np.searchsorted(owner, [rows.start, rows.stop]))
                if len(lists):
                    p, mine = column["positive"][lists][:, None], owner[lists] - s
                    scores = scores[mine]
                    best.add(lists, scores, ~same[mine] & (least * p <= 100 * scores) & (100 * scores <= most * p), vec, tie)

        for batch in batches:
            block, share, asks = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("block", "share", "asks"))
            turns = np.flatnonzero(np.append(True, (np.diff(block) != 0) | (np.diff(share) != 0) | (np.diff(asks.astype(int)) != 0))) if len(block) else []
            for b, e in zip(turns, np.append(turns[1:], len(block)), strict=True):
                if (block[b], share[b]) != key:
                    if state:
                        yield out()
                    key, parts, state = (block[b], share[b]), [], None
                if asks[b]:
                    parts.append(batch.slice(b, e - b))
                elif parts:
                    state = state or ready()
                    for s in range(b, e, batch_rows):
                        add(batch.slice(s, min(batch_rows, e - s)))
        if state:
            yield out()

    return run


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec", "tie")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(table: DataFrame, label: Column | None = None, every: int = 50, scale: int = 256, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, block: int = 4096) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``table(vec_id, embedding, label)``.

    Anchors are the rows whose vec_id is divisible by ``every``; ``label`` may change the label (of columns vec_id, label).  Each anchor's ``positives``
    best rows of its label, and for each of them the ``negatives`` best rows of other labels whose scores are ``least`` to ``most`` percent of the positive's.
    """
    spark = table.sparkSession
    rows = pick(table, vec_id="long", embedding="array<double>", label="long").where("vec_id is not null and label is not null and size(embedding) > 0")
    rows = rows.where(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    common = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if common is None:
        return empty
    width = common["width"]
    rows = rows.where(F.size("embedding") == width).where(F.forall("embedding", lambda c: F.abs(c) * scale < (1 << 31) / math.sqrt(width)))
    rows = rows.withColumn("x", F.transform("embedding", lambda c: F.floor(scale * c)))
    rows = rows.select("vec_id", (F.col("label") if label is None else label).cast("long").alias("label"), "x").where("label is not null").distinct()
    rows = written(rows.withColumn("tie", F.xxhash64("label", "x")))
    asked = F.col("vec_id") % every == 0
    size = F.aggregate("x", F.lit(0).cast("long"), lambda a, c: a + F.abs(c))
    seen = rows.agg(F.count("*").alias("n"), F.count_if(asked).alias("anchors"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"), F.max(F.when(asked, size)).alias("reach")).first()
    if not seen["anchors"]:
        return empty
    fields = Fields(min(seen["low"], 0), max(seen["high"], 0), max(int(seen["reach"]), 1))
    blocks = math.ceil(seen["anchors"] / block)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # enough shares to keep every task busy, none smaller than a batch
    shares = max(1, min(math.ceil(2 * tasks / blocks), math.ceil(seen["n"] / 1024)))
    dealt = F.xxhash64("vec_id", "tie")
    anchors = rows.where(asked).withColumn("block", F.pmod(dealt, F.lit(blocks)).cast("int"))
    told = rows.select("*", F.pmod(F.xxhash64("vec_id", "tie", F.lit(1)), F.lit(shares)).cast("int").alias("share"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def scored(asking: DataFrame, k: int, windows: int) -> DataFrame:
        columns = ["block", "share", "asks", "vec_id", "tie", "label", "x", "positives"]
        asks = asking.select("*", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(True).alias("asks")).select(*columns)
        tells = told.select("*", F.lit(False).alias("asks"), F.lit(None).cast("array<long>").alias("positives")).select(*columns)
        sent = asks.unionByName(tells).repartition(blocks * shares, "block", "share").sortWithinPartitions("block", "share", F.desc("asks"), "vec_id", "tie")
        schema = "anchor long, anchor_tie long, vec long, tie long, score long" + (", positive long" if windows else "")
        return sent.mapInArrow(_streamed(fields, width, k, windows, least, most), schema)

    first = scored(anchors.withColumn("positives", F.lit(None).cast("array<long>")), positives, 0)
    first = written(_best(first, ["anchor", "anchor_tie"], positives))
    held = first.groupBy("anchor", "anchor_tie").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("positives"))
    asking = anchors.join(held, (F.col("vec_id") == F.col("anchor")) & (anchors["tie"] == F.col("anchor_tie"))).select(*anchors.columns, "positives")
    second = _best(scored(written(asking), negatives, positives), ["anchor", "anchor_tie", "positive"], negatives)
    second = second.select("anchor", "anchor_tie", (F.col("positive") + 1).alias("place"), F.col("rank").alias("n"), F.col("vec").alias("negative_id"), F.col("score").alias("negative_score"))
    chosen = first.select("anchor", "anchor_tie", F.col("rank").alias("place"), F.col("vec").alias("positive_id"), F.col("score").alias("positive_score"))
    return chosen.join(second, ["anchor", "anchor_tie", "place"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("n").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
