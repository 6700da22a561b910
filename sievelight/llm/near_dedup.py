"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents are sets of distinct 5-word shingles (words lower-cased over A-Z; a shorter text is one shingle
of all its words; no words, no set).  Two documents link when ``100 * |A n B| >= percent * |A u B|``.

1.  One pass per document makes a MinHash signature and a 128-bit digest of the set.
    Equal sets become one class, so copies never meet each other again.
2.  Bands of 5 values give buckets: as many (24 at 0.85, 35 at 0.8) that a pair at the limit misses all of them with probability
    ``miss`` at most.  A bucket links to its smallest member first (a star), never to all pairs.
3.  Signatures are compared 24 values at a time.  After each batch the posterior of the similarity
    (uniform prior) is known from the matches, and a pair whose chance of reaching the threshold is below
    ``miss`` is dropped; those left are verified on the full sets.
4.  Where a bucket still holds several components, its members outside the largest one are compared with
    all its members of other components, in blocks of bounded size inside tasks, by signature and then on
    full sets, so that no link between components is lost and none within one is looked for.
5.  Connected components over the verified links.

Defined results: null or empty text has 0 shingles and stands alone; a null doc_id links with nothing,
has a null component and is kept; different texts under one doc_id are classes of their own, and link through it with nothing;
repeated rows are returned as often as they came; other columns of the
input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import BlockedBloom, components, pick, row_key, written

ROWS, BATCH, MOST = 5, 24, 1 << 12
_MULTIPLIERS = np.random.default_rng(20).integers(0, 1 << 63, MOST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FEATURES = "doc_id long, row_key long, n_shingles long, low long, high long, signature binary, bands array<long>"


def bands_for(percent: int, miss: float) -> int:
    """The fewest bands of ROWS values that a pair at the limit misses altogether with a chance of at most ``miss``."""
    return min(MOST // ROWS, math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** ROWS)))) if percent < 100 else 1


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, joined, with offsets."""
    words = K.split_words(column, lower=True)
    hashes = words.hashes()
    key, at = K.windows(words, hashes, n)
    text = words.text[at]
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        # fewer words than a shingle: the whole sequence is one shingle, told apart by its length
        power, _ = K.powers(K.WORD_BASES[1], n + 1)
        one = np.array([K.mix64(np.array([np.sum(hashes[words.first[d] : words.first[d + 1]] * power[: words.count[d]], dtype=np.uint64) + np.uint64(words.count[d])]))[0] for d in short], np.uint64)
        key, text = np.concatenate([key, one]), np.concatenate([text, short])
    key, _, first = K.unique_per_text(key, text, len(words.count))
    return key, first


def signatures(key: np.ndarray, first: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash signatures, a row of ``hashes`` 32-bit values for each set (all ones for an empty one)."""
    out = np.full((len(first) - 1, hashes), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        for k in range(hashes):
            out[full, k] = np.minimum.reduceat(key * _MULTIPLIERS[k], first[full]) >> np.uint64(32)
    return out


def _digest(key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return K.segment_sum(key.view(np.int64), first), K.segment_sum(K.mix64(key ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64), first)


def _features(n: int, bands_n: int):
    def run(batches):
        for batch in batches:
            for part in K.slices(batch, "text"):
                key, first = shingle_sets(part.column("text"), n)
                size = np.diff(first)
                low, high = _digest(key, first)
                sig = signatures(key, first, bands_n * ROWS)
                power, _ = K.powers(K.BASES[1], ROWS + 1)
                bands = sig.reshape(-1, bands_n, ROWS).astype(np.uint64) + np.uint64(1)
                bands = K.mix64((bands * power[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(bands_n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                kept = np.where(size > 0, bands_n, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("row_key"),
                        pa.array(size, pa.int64()),
                        pa.array(low, pa.int64()),
                        pa.array(high, pa.int64()),
                        K.binary_column(sig.view(np.uint8).ravel(), np.arange(len(sig) + 1) * bands_n * ROWS * 4),
                        K.list_column(bands[size > 0].ravel().view(np.int64), np.append(0, np.cumsum(kept)), pa.int64()),
                    ],
                    names=["doc_id", "row_key", "n_shingles", "low", "high", "signature", "bands"],
                )

    return run


@lru_cache
def least_matches(percent: int, miss: float, hashes: int) -> tuple[int, ...]:
    """For each batch end, the fewest matches at which P(similarity >= percent/100 | matches) >= miss.

    With a uniform prior the posterior is Beta(m + 1, k - m + 1); its upper tail at t is the chance that a
    Binomial(k + 1, t) is at most m.
    """
    t, out = percent / 100, []
    for k in range(BATCH, hashes + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
        out.append(m)
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray, percent: int, miss: float) -> np.ndarray:
    """Indices of the pairs of signature rows that sequential verification does not drop."""
    at, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for b, least in enumerate(least_matches(percent, miss, left.shape[1])):
        cut = slice(b * BATCH, (b + 1) * BATCH)
        matches = matches + (left[at, cut] == right[at, cut]).sum(axis=1)
        stay = matches >= least
        at, matches = at[stay], matches[stay]
    return at


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = _binary(column)
    return data.view(np.uint32).reshape(len(column), -1)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].copy(), at - at[0]


def _prune(percent: int, miss: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at = survivors(_matrix(batch.column("sa")), _matrix(batch.column("sb")), percent, miss)
                yield batch.select(["a", "b"]).take(pa.array(at))

    return run


def _exact(percent: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            for part in K.slices(batch, "text"):
                key, first = shingle_sets(part.column("text"), n)
                low, high = _digest(key, first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(low, pa.int64()), pa.array(high, pa.int64()), K.binary_column(key.view(np.uint8), first * 8)], names=["doc_id", "low", "high", "x"])

    return run


def _cross(percent: int, miss: float):
    """Of one block of a bucket: the stragglers against the members of other components, on signatures, then on full sets.

    A straggler needs one link to each component, so one is returned.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sig = _matrix(table.column("signature").combine_chunks())
        rep, comp, asks = (table.column(c).to_numpy() for c in ("rep", "component", "asks"))
        data, at = _binary(table.column("x").combine_chunks())
        code, first = np.unique(data.view(np.uint64), return_inverse=True)[1], at // 8
        size, mark = np.diff(first), np.zeros(len(code) + 1, bool)
        other, a, b = np.flatnonzero(~asks), [], []
        for i in np.flatnonzero(asks):
            to = other[comp[other] != comp[i]]
            to = to[survivors(np.broadcast_to(sig[i], (len(to), sig.shape[1])), sig[to], percent, miss)]
            mine = code[first[i] : first[i + 1]]
            mark[mine] = True
            both = K.segment_sum(mark[code[K.ranges(first[to], size[to])]].astype(np.int64), np.append(0, np.cumsum(size[to])))
            mark[mine] = False
            to = to[100 * both >= percent * (size[i] + size[to] - both)]
            to = to[np.unique(comp[to], return_index=True)[1]]
            a.append(np.minimum(rep[i], rep[to]))
            b.append(np.maximum(rep[i], rep[to]))
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"a": join(a), "b": join(b)})

    return run


def _full_sets(ids: DataFrame, nodes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """``(id, x)``: the shingle sets of the named classes.  Only texts of their documents leave the scan."""
    named = written(ids.join(nodes, F.col("id") == F.col("node")).select("id", "rep", F.col("low").alias("l"), F.col("high").alias("h")))
    reps = written(named.select("rep").distinct())
    few = BlockedBloom(reps, "rep", reps.count()).maybe(docs, "doc_id").join(reps, F.col("doc_id") == F.col("rep")).select("doc_id", "text")
    sets = few.mapInArrow(_sets(n), "doc_id long, low long, high long, x binary")
    mine = (F.col("doc_id") == F.col("rep")) & (F.col("low") == F.col("l")) & (F.col("high") == F.col("h"))
    return written(sets.dropDuplicates(["doc_id", "low", "high"]).join(named, mine).select("id", "x"))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs that pass on their full sets."""
    sets = _full_sets(written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), nodes, docs, n)
    both = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    return written(both.mapInArrow(_exact(percent), "a long, b long"))


def _classes(full: DataFrame) -> DataFrame:
    """``(node, rep, low, high, n)``: the classes of equal sets.  A class's number is its smallest doc_id; where other texts of that doc_id
    make classes too, a negative hash of the set."""
    classes = written(full.groupBy("low", "high", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep")))
    twice = classes.groupBy(F.col("rep").alias("_rep")).agg(F.count("*").alias("_n")).where("_n > 1").select("_rep")
    node = F.when(F.col("_rep").isNull(), F.col("rep")).otherwise(-F.shiftrightunsigned(F.xxhash64("low", "high", "n"), 1) - 1)
    return written(classes.join(written(twice), F.col("rep") == F.col("_rep"), "left").select(node.alias("node"), "rep", "low", "high", "n"))


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, miss: float = 1e-6, block: int = 512, keyed: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``.

    With ``keyed`` comes also ``row_key`` (see :func:`.common.row_key`), which tells different texts of one doc_id apart.
    """
    docs = pick(docs, doc_id="long", text="string").withColumn("row_key", row_key())
    rows = written(docs.mapInArrow(_features(shingle, bands_for(percent, miss)), FEATURES))
    full = rows.where("n_shingles > 0 and doc_id is not null")
    nodes = _classes(full)
    # one row of each class carries its signature: that of its smallest document
    one = nodes.select("node", "rep", F.col("low").alias("l"), F.col("high").alias("h"))
    firsts = full.join(one, (F.col("doc_id") == F.col("rep")) & (F.col("low") == F.col("l")) & (F.col("high") == F.col("h"))).dropDuplicates(["node"])
    banded = firsts.select(F.col("node").alias("rep"), F.explode("bands").alias("bucket"))
    stars = banded.groupBy("bucket").agg(F.min("rep").alias("lead"), F.count("*").alias("size")).where("size > 1")
    members = written(banded.join(stars, "bucket"))
    ids = members.select("rep").distinct()
    signs = written(firsts.select(F.col("node").alias("rep"), "signature").join(ids, "rep", "left_semi"))
    pairs = members.where("lead <> rep").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    signed = pairs.join(signs.toDF("a", "sa"), "a").join(signs.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    likely = written(signed.mapInArrow(_prune(percent, miss), "a long, b long"))
    links = _verified(likely, nodes, docs, shingle, percent)
    found = written(components(links))
    # buckets that still hold several components
    labelled = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "size", F.coalesce("component", "rep").alias("component"))
    sizes = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.count("*").alias("kinds"), (F.sum("n") - F.max("n")).alias("asking")).where("kinds > 1")
    mixed = written(labelled.join(main, "bucket"))
    sets = _full_sets(written(mixed.select(F.col("rep").alias("id")).distinct()), nodes, docs, shingle)
    mixed = mixed.join(signs, "rep").join(sets.withColumnRenamed("id", "rep"), "rep")
    cell = lambda count: F.ceil(F.col(count) / block).cast("int")
    spot = lambda count: F.pmod(F.xxhash64("rep", "bucket"), cell(count)).cast("int")
    asks = mixed.where("component <> main").select("bucket", "rep", "component", "signature", "x", F.lit(True).alias("asks"), spot("asking").alias("i"), F.explode(F.sequence(F.lit(0), cell("size") - 1)).alias("j"))
    told = mixed.select("bucket", "rep", "component", "signature", "x", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), cell("asking") - 1)).alias("i"), spot("size").alias("j"))
    more = asks.unionByName(told).groupBy("bucket", "i", "j").applyInArrow(_cross(percent, miss), "a long, b long")
    found = written(components(links.union(more)))
    # components go by their smallest document
    least = found.join(nodes, "node").groupBy("component").agg(F.min("rep").alias("least"))
    found = found.join(least, "component").select(F.col("node").alias("_node"), "least")
    named = nodes.join(found, F.col("node") == F.col("_node"), "left").select(F.col("low").alias("l"), F.col("high").alias("h"), "n", F.coalesce("least", "rep").alias("found"))
    same = (F.col("low") == F.col("l")) & (F.col("high") == F.col("h")) & (F.col("n_shingles") == F.col("n")) & F.col("doc_id").isNotNull()
    out = rows.select("doc_id", "row_key", "n_shingles", "low", "high").join(named, same, "left").select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"), "row_key")
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return out.select("doc_id", "n_shingles", "component_id", "kept", *(["row_key"] if keyed else []))
