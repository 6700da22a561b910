"""Approximate nearest neighbours by inner product over several shifted Hilbert orderings.

1.  Equal vectors become one class that keeps its ``k + 1`` smallest ids (no answer needs more), so a
    vector that a third of all rows hold is searched once.
2.  Each ordering projects the vectors onto its own orthonormal directions, maps each coordinate through
    the quantiles of a bounded sample (``sample`` vectors), shifts the grid at random and takes the Hilbert
    key.  Spark range-partitions and sorts all keys; partition offsets turn them into exact ranks.
3.  The half window is measured, not guessed: the exact neighbours of ``probes`` sampled queries are found
    in one pass over all vectors, and the window is the ``recall`` quantile of how near in rank, in their
    best ordering, the neighbours stand.  On clustered vectors it is small; on vectors without structure it
    must be a share of the table, which is what their geometry asks for.
4.  Ranks fall into blocks of bounded size; a query visits the blocks its window touches, each of which
    returns its best candidates with exact double-precision scores; these merge per query.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do
rows without a vec_id; a vec_id that comes more than once is one candidate (its best score counts) and is
never its own neighbour; other columns are ignored; an empty table gives an empty result.  Vectors of
another length than the most common sampled one take no part either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

RANKED = "ordering int, rep long, pid int, idx long"
HITS = "query long, rep long, score double"


class Orderings:
    """Projection directions, quantile samples and shifts of the orderings, fitted on sampled vectors."""

    def __init__(self, sample: np.ndarray, count: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        self.bits, self.dims = bits, min(dims, width)
        self.axes, self.shifts, basis, at = [], [], None, width
        for _ in range(count):
            if at + self.dims > width:
                basis, at = np.linalg.qr(rng.normal(size=(width, width)))[0], 0
            self.axes.append(basis[:, at : at + self.dims])
            self.shifts.append(rng.random(self.dims))
            at += self.dims
        self.levels = [np.sort(sample @ a, axis=0) for a in self.axes]

    def keys(self, vectors: np.ndarray, j: int) -> np.ndarray:
        across = vectors @ self.axes[j]
        share = np.stack([np.searchsorted(self.levels[j][:, i], across[:, i]) for i in range(self.dims)], axis=1) / len(self.levels[j])
        cells = ((share + self.shifts[j]) * (1 << (self.bits - 1))).astype(np.int64)
        return hilbert_keys(np.minimum(cells, (1 << self.bits) - 1), self.bits)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``cells`` (n, dims), coordinates below 2**bits.

    Skilling's in-place transform from axes to the transposed index, over whole columns; dims * bits <= 63.
    """
    x = np.ascontiguousarray(cells.T.astype(np.int64))
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _keyed(orders: Orderings):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = _vectors(batch.column("v"))
                for j in range(len(orders.axes)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), j, np.int32)), pa.array(orders.keys(v, j)), batch.column("rep")], names=["ordering", "key", "rep"])

    return run


def _numbered(batches):
    """Numbers the sorted rows of each ordering within this partition."""
    pid, last, done = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ordering = batch.column("ordering").to_numpy()
        new = np.append(True, ordering[1:] != ordering[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        idx = np.arange(len(new)) - lead
        if ordering[0] == last:
            idx += np.where(lead == 0, done, 0)
        last, done = ordering[-1], idx[-1] + 1
        yield pa.RecordBatch.from_arrays([batch.column("ordering"), batch.column("rep"), pa.array(np.full(len(new), pid, np.int32)), pa.array(idx)], names=["ordering", "rep", "pid", "idx"])


def best(queries: np.ndarray, names: np.ndarray, vectors: np.ndarray, reps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query; the scores are summed in one fixed order, so equal pairs score equally."""
    out = []
    for s in range(0, len(queries), 256):
        q = queries[s : s + 256]
        rough = q @ vectors.T
        if len(vectors) > k:
            least = np.partition(rough, len(vectors) - k, axis=1)[:, len(vectors) - k] - 1e-9
            row, col = np.nonzero(rough >= least[:, None])
        else:
            row, col = (x.ravel() for x in np.indices(rough.shape))
        score = np.einsum("ij,ij->i", q[row], vectors[col])
        order = np.lexsort((reps[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        out.append((names[s + row[keep]], reps[col[keep]], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _hits(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query", "rep", "score"])


def _brute(names: np.ndarray, queries: np.ndarray, k: int):
    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                yield _hits(best(queries, names, _vectors(part.column("v")), part.column("rep").to_numpy(), k))

    return run


def _block(k: int):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        v, rep = _vectors(table.column("v").combine_chunks()), table.column("rep").to_numpy()
        if not asks.any() or asks.all():
            return pa.table({"query": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.Table.from_batches([_hits(best(v[asks], rep[asks], v[~asks], rep[~asks], k))])

    return run


def exact_sample(classes: DataFrame, probes: list, k: int) -> DataFrame:
    """Exact best classes of a bounded list of (rep, v) probes, in one pass over all classes."""
    names, queries = np.array([r.rep for r in probes], np.int64), np.array([r.v for r in probes], np.float64)
    found = classes.mapInArrow(_brute(names, queries, k), HITS)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def search(
    table: DataFrame, k: int = 20, every: int = 20, orderings: int = 16, dims: int = 8, bits: int = 4, sample: int = 4096, probes: int = 128, recall: float = 0.96, block: int = 4096, seed: int = 9
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of each row of ``table(vec_id, embedding)`` with ``vec_id % every = 0``."""
    spark = table.sparkSession
    rows = pick(table, vec_id="long", embedding="array<double>").where("vec_id is not null and size(embedding) > 0")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(fine).select("vec_id", F.col("embedding").alias("v"))
    width = rows.select(F.size("v").alias("n"), F.xxhash64("vec_id").alias("h")).orderBy("h").limit(sample).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    result = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("v") == width.n)
    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.dropDuplicates().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    classes = written(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("v", "ids", F.col("ids")[0].alias("rep")))
    asking = written(rows.where(F.col("vec_id") % every == 0).dropDuplicates())
    asked = written(asking.select("v").distinct().join(classes.select("v", "rep"), "v"))
    size = classes.count()
    picked = classes.select("v").orderBy(F.xxhash64("rep", F.lit(seed))).limit(sample).collect()
    orders = Orderings(np.array([r.v for r in picked]), orderings, dims, bits, seed)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = classes.select("rep", "v").mapInArrow(_keyed(orders), "ordering int, key long, rep long")
    placed = written(keyed.repartitionByRange(parts, "ordering", "key", "rep").sortWithinPartitions("ordering", "key", "rep").mapInArrow(_numbered, RANKED))
    counts = placed.groupBy("ordering", "pid").agg(F.count("*").alias("n"))
    before = counts.select("ordering", "pid", (F.sum("n").over(Window.partitionBy("ordering").orderBy("pid")) - F.col("n")).alias("offset"))
    ranks = written(placed.join(F.broadcast(before), ["ordering", "pid"]).select("ordering", "rep", (F.col("offset") + F.col("idx")).alias("rank")))
    probe = asked.orderBy(F.xxhash64("rep", F.lit(seed))).limit(probes).collect()
    if not probe:
        return spark.createDataFrame([], result)
    true = exact_sample(classes.select("rep", "v"), probe, k + 1).where("query <> rep")
    near = true.join(ranks.select(F.col("rep").alias("query"), "ordering", F.col("rank").alias("at")), "query").join(ranks, ["ordering", "rep"])
    gaps = near.groupBy("query", "rep").agg(F.min(F.abs(F.col("rank") - F.col("at"))).alias("gap"))
    half = int(gaps.agg(F.coalesce(F.percentile("gap", recall), F.lit(0.0))).first()[0]) + 1
    cell = max(1, min(half, block, size))
    reach = -(-half // cell)
    stand = ranks.withColumn("block", F.floor(F.col("rank") / cell))
    told = stand.join(classes.select("rep", "v"), "rep").select("ordering", "block", "rep", "v", F.lit(False).alias("asks"))
    steps = F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach))
    asks = stand.join(asked, "rep").select("ordering", steps.alias("block"), "rep", "v", F.lit(True).alias("asks"))
    hits = told.unionByName(asks).groupBy("ordering", "block").applyInArrow(_block(k + 1), HITS)
    hits = hits.groupBy("query", "rep").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    top = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = top.join(classes.select("rep", "ids"), "rep").groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "ids")).alias("found"))
    lists = lists.join(asked.withColumnRenamed("rep", "query"), "query").select("v", "found")
    ids = asking.join(lists, "v").select(F.col("vec_id").alias("query_id"), F.flatten(F.transform("found", lambda x: F.transform(x.ids, lambda i: F.struct(x.s.alias("s"), i.alias("id"))))).alias("all"))
    ids = ids.select("query_id", F.explode(F.slice(F.array_sort(F.filter("all", lambda x: x.id != F.col("query_id"))), 1, 2 * k)).alias("hit"))
    # a vec_id with several vectors meets its best score only
    ids = ids.groupBy("query_id", F.col("hit.id").alias("vec_id")).agg((-F.min("hit.s")).alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ids.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
