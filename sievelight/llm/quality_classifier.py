"""Quality classification by the perplexity of an interpolated modified Kneser-Ney 3-gram model.

Training text is trusted: documents labelled good and not toxic, less a tenth (drawn by a hash of doc_id) that is
held out for thresholds, and of the rest the ``max_docs`` first by another hash.  That bound is what keeps the model
bounded: its vocabulary is every word that training saw twice (a word's number has 21 bits, so two million at most), every other
word is one unknown class shared out evenly over the kinds of unknown words seen, and 3-grams of word numbers are packed exactly
into 63 bits.

Discounts, continuation counts and back-off masses are grouped counts and joins.  Written with back-off masses, the log
probability of a document is a sum over its n-grams of a weight for each n-gram of the model: zero for
n-grams outside it.  So scoring is a join of document n-gram counts with a weight table:

*   words and the ``head`` most frequent n-grams have their weights in the task (bounded tables);
*   other n-grams pass a bit table of the model's n-grams (of fixed size) and go, pre-aggregated over a slice of
    documents, to the shard of their key, where they meet the shard of the weight table; partial sums per document
    come back.  A group is one shard and one salt; there are as many salts as keep a group's request small.

Every document is scored over its whole text.  Perplexity is per token, the end counted as one.  The threshold of a
language is the ``quantile`` of the perplexities of its held-out trusted documents, drawn towards that of all languages as
if ``prior`` more documents of the language stood there (a mean of logs); documents above it are rejected.

Defined results: null or empty text is one token, the end; its perplexity is given, and it is not kept, as there is
nothing to keep; a null language is a language of its own; a null doc_id is never trusted; repeated rows are scored
alike; other columns are ignored; an empty table gives none; with no trusted text every document with a word is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import pick, written
from .sharded import Lookup, columns, expand, expand_sorted, pack, salts_for, shard_of, squeeze, squeeze_sorted, unpack

BITS = 21  # of a word's number
MASK, PAIR = (1 << BITS) - 1, (1 << 2 * BITS) - 1
BLOCK = 1 << 20  # bits of a block of the table of model n-grams
LISTS = ("last", "one", "middle", "once", "twice", "more", "total", "stats")
UNKNOWN, START, END, FIRST = 0, 1, 2, 3
TOP = np.int64(-(1 << 63))  # tells pairs from triples
FLAGS = 1 << 27  # bits of the table of model n-grams
PASS = "uid long, doc_id long, lang string, words long, score double, shard int, keys binary, size binary, docs binary, times binary"


def numbered(words: K.Words, vocab: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of each text between two starts and an end, joined, and n+1 offsets."""
    hit, number = vocab.find(words.hashes())
    first = words.first + 3 * np.arange(len(words.first))
    out = np.full(first[-1], START, np.int64)
    out[K.ranges(first[:-1] + 2, words.count)] = np.where(hit, number, UNKNOWN)
    out[first[1:] - 1] = END
    return out, first


def _key2(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (ids[at - 1] << BITS) | ids[at]


def _key3(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (ids[at - 2] << 2 * BITS) | (ids[at - 1] << BITS) | ids[at]


def _word_counts(batches):
    for batch in batches:
        for part in K.slices(batch, "text", 1 << 22):
            words = K.split_words(part.column("text"))
            key, count = np.unique(words.hashes(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], names=["word", "n"])


def _triples(vocab: Lookup, parts: int):
    """Packed counts of the 3-grams of a slice, dealt by their middle word."""

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, "text", 1 << 22):
                ids, first = numbered(K.split_words(part.column("text")), vocab)
                inside = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
                key, count = np.unique(_key3(ids, np.flatnonzero(inside >= 2)), return_counts=True)
                where = shard_of(((key >> BITS) & MASK).view(np.uint64), parts)
                full = np.unique(where).tolist()
                mine = [where == i for i in full]
                blobs = [pa.array([f(x[m]) for m in mine], pa.binary()) for f, x in ((squeeze_sorted, key), (squeeze, count.astype(np.uint32)))]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *blobs], names=["part", "keys", "counts"])

    return run


def _merged(table: pa.Table) -> pa.Table:
    """The 3-grams of one part added up; what the discounts and the lower levels need of them: counts of counts (3-grams, pairs),
    pairs by last word, and by middle word how many pairs there are with a count of one, two and more, and their total."""
    rows = list(zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True))
    key, where = np.unique(np.concatenate([expand_sorted(k) for k, _ in rows]).view(np.int64), return_inverse=True)
    count = np.bincount(where, np.concatenate([expand(c, np.uint32) for _, c in rows]), len(key)).astype(np.int64)
    pair, c2 = np.unique(key & PAIR, return_counts=True)
    last, one = np.unique(pair & MASK, return_counts=True)
    middle, at = np.unique(pair >> BITS, return_inverse=True)
    kinds = [np.bincount(at, x, len(middle)).astype(np.int64) for x in (c2 == 1, c2 == 2, c2 > 2, c2)]
    stats = [int((c == i).sum()) for c in (count, c2) for i in range(1, 5)]
    lists = [last, one, middle, *kinds, np.array(stats)]
    return pa.table({"part": table.column("part").slice(0, 1), "keys": pa.array([squeeze_sorted(key)], pa.binary()), "counts": pa.array([squeeze(count.astype(np.uint32))], pa.binary())} | {n: pa.array([x.tolist()], pa.list_(pa.int64())) for n, x in zip(LISTS, lists, strict=True)})


def _discounts(n: list[float]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts."""
    if not n[0] or not n[1]:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i / 2 for i in (1, 2, 3)]
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in zip((1, 2, 3), raw, strict=True))


class Grades:
    """Weights of the n-grams of a part, which holds all triples of its middle words.

    A triple's context and its lower pair share the middle word, so both levels are settled here: a triple and a pair
    weigh their gain over backing off, a pair that is a context also its back-off mass.  A pair's two weights come from two
    parts and add up where they are used.
    """

    def __init__(self, d3, d2, log_one: np.ndarray):
        self.d3, self.d2, self.log_one = d3, d2, log_one

    @staticmethod
    def _by(group: np.ndarray, c: np.ndarray, d):
        """Totals of a sorted grouping, spread over its members, and logs of the back-off masses."""
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(head, len(group)))
        total = np.add.reduceat(c, head)
        log_mass = np.log(np.add.reduceat(_cut(c, d), head) / total)
        return head, log_mass, np.repeat(total, size), np.repeat(log_mass, size)

    def rows(self, batch):
        """``(keys, weights, counts)`` of the triples, the pairs, and the pairs as contexts, each with rising keys."""
        for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            key, c = expand_sorted(keys).view(np.int64), expand(counts, np.uint32).astype(float)
            pair, inverse, c2 = np.unique(key & PAIR, return_inverse=True, return_counts=True)
            _, _, total, log_mass = self._by(pair >> BITS, c2.astype(float), self.d2)
            low = self.log_one[pair & MASK]
            log_two = np.log((c2 - _cut(c2, self.d2)) / total + np.exp(log_mass + low))
            yield pair | TOP, log_two - log_mass - low, 2 * c2
            head, contexts, total, log_mass = self._by(key >> BITS, c, self.d3)
            yield (key >> BITS)[head] | TOP, contexts, np.zeros(len(head))
            low = log_two[inverse]
            yield key, np.log((c - _cut(c, self.d3)) / total + np.exp(log_mass + low)) - log_mass - low, c

    def often(self, batches):
        """The n-grams that training saw twice or more."""
        for batch in batches:
            for key, _, c in self.rows(batch):
                yield pa.RecordBatch.from_arrays([pa.array(key[c > 1]), pa.array(c[c > 1].astype(np.int64))], names=["key", "c"])

    def of(self, wanted: np.ndarray):
        """The weights of some n-grams (rising keys)."""

        def run(batches):
            table = Lookup(wanted, wanted)
            for batch in batches:
                for key, weight, _ in self.rows(batch):
                    hit = table.find(key)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(weight[hit])], names=["key", "weight"])

        return run

    def bits(self, batches):
        """The places of n-grams in the bit table, by blocks of it."""
        for batch in batches:
            bit = [_bit(key.view(np.uint64)) for key, _, _ in self.rows(batch)]
            if bit:
                bit = np.unique(np.concatenate(bit)).astype(np.int64)
                block = bit // BLOCK
                for i in np.unique(block).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([squeeze(np.diff(bit[block == i] - i * BLOCK, prepend=0).astype(np.int32))], pa.binary())], names=["block", "bits"])

    def told(self, shards: int):
        """The weight table packed by shard."""

        def run(batches):
            for batch in batches:
                for key, weight, _ in self.rows(batch):
                    shard = shard_of(key.view(np.uint64), shards)
                    full = np.unique(shard).tolist()
                    mine = [shard == i for i in full]
                    blobs = [pa.array([f(x[m]) for m in mine], pa.binary()) for f, x in ((squeeze_sorted, key), (squeeze, weight.astype(np.float32)))]
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *blobs], names=["shard", "keys", "weights"])

        return run


def _cut(c: np.ndarray, d) -> np.ndarray:
    return np.where(c == 1, d[0], np.where(c == 2, d[1], d[2]))


def _bit(key: np.ndarray) -> np.ndarray:
    return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 27)


def _joined(table: pa.Table) -> pa.Table:
    """One block of the bit table."""
    bits = np.zeros(BLOCK, bool)
    for blob in table.column("bits").to_pylist():
        bits[np.cumsum(expand(blob, np.int32))] = True
    return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def train(docs: DataFrame, ids: DataFrame, head: int, parts: int, shards: int):
    """Vocabulary, word weights, the head's weights, the bit table, and the packed table of all weights.

    Counts leave the tasks packed (rising keys by their steps, compressed); one exchange brings the 3-grams of a middle word together, and
    one small table of them is all that is stored.
    """
    text = docs.join(F.broadcast(ids), "doc_id").select("text")  # at most max_docs ids
    counts = written(text.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    kept = columns(counts.where("n > 1").orderBy(F.desc("n"), "word").limit(MASK - FIRST).select("word"))["word"]
    unknown_kinds = counts.count() - len(kept) + 1
    vocab = Lookup(kept.view(np.uint64), np.arange(len(kept), dtype=np.int64) + FIRST)
    packed = text.mapInArrow(_triples(vocab, parts), "part int, keys binary, counts binary")
    three = written(packed.groupBy("part").applyInArrow(_merged, "part int, keys binary, counts binary, " + ", ".join(f"{n} array<long>" for n in LISTS)))
    size = len(kept) + 2  # words, the unknown class and the end
    pairs = lambda *names: F.explode(F.arrays_zip(*names)).alias("x")
    one = columns(three.select(pairs("last", "one")).groupBy("x.last").agg(F.sum("x.one").alias("one")))  # a row a word
    by_middle = columns(three.select(pairs("middle", "once", "twice", "more", "total")).select("x.*"))  # a row a word
    stats = np.array([r.stats for r in three.select("stats").collect()] or [[0] * 8]).sum(axis=0).astype(float).tolist()  # a row a part
    c = one["one"].astype(float)
    d3, d2, d1 = _discounts(stats[:4]), _discounts(stats[4:]), _discounts([float((c == i).sum()) for i in range(1, 5)])
    mass, total = (_cut(c, d1).sum(), c.sum()) if len(c) else (1.0, 1.0)
    log_one = np.full(len(kept) + FIRST, math.log(mass / total / size))
    if len(c):
        log_one[one["last"]] = np.log((c - _cut(c, d1)) / total + mass / total / size)
    word = log_one.copy()
    word[START] = 0.0
    word[UNKNOWN] -= math.log(unknown_kinds)
    word[by_middle["middle"]] += np.log((d2[0] * by_middle["once"] + d2[1] * by_middle["twice"] + d2[2] * by_middle["more"]) / np.maximum(by_middle["total"], 1))
    grades, blobs = Grades(d3, d2, log_one), three.select("keys", "counts")
    top = columns(blobs.mapInArrow(grades.often, "key long, c long").orderBy(F.desc("c"), "key").limit(head).select("key"))["key"]
    top_rows = columns(blobs.mapInArrow(grades.of(np.sort(top)), "key long, weight double").groupBy("key").agg(F.sum("weight").alias("weight")))  # at most head rows
    heads = Lookup(top_rows["key"].view(np.uint64), top_rows["weight"])
    table = np.zeros(FLAGS // 64, np.int64)
    for r in blobs.mapInArrow(grades.bits, "block int, bits binary").groupBy("block").applyInArrow(_joined, "block int, bits binary").collect():  # FLAGS bits in all
        table[r.block * BLOCK // 64 : (r.block + 1) * BLOCK // 64] = np.frombuffer(r.bits, np.int64)
    return vocab, word, heads, table.view(np.uint64), blobs.mapInArrow(grades.told(shards), "shard int, keys binary, weights binary")


def _scan(vocab: Lookup, word: np.ndarray, heads: Lookup, flags: np.ndarray, shards: int):
    """Scores what a task can by itself, and packs the rest as requests of shards."""

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in K.slices(batch, "text", 1 << 22):
                yield from scan(part, uid)
                uid += part.num_rows

    def scan(part, uid):
        n = part.num_rows
        words = K.split_words(part.column("text"))
        ids, first = numbered(words, vocab)
        owner = np.repeat(np.arange(n), np.diff(first))
        inside = np.arange(len(ids)) - first[owner]
        base = np.where(inside >= 1, word[ids], 0.0)
        two, three = np.flatnonzero(inside >= 1), np.flatnonzero(inside >= 2)
        key = np.concatenate([_key2(ids, two).view(np.uint64) | np.uint64(1 << 63), _key3(ids, three).view(np.uint64)])
        doc = np.concatenate([owner[two], owner[three]])
        bit = _bit(key)
        there = np.flatnonzero(((flags[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)) != 0)
        key, doc = key[there], doc[there]
        hit, weight = heads.find(key)
        score = K.segment_sum(base, first) + np.bincount(doc[hit], weight[hit], minlength=n)
        yield rows(np.arange(n) + uid, part.column("doc_id"), part.column("lang"), pa.array(words.count), pa.array(score))
        key, doc = key[~hit], doc[~hit]
        if not len(key):
            return
        shard, *columns = pack(key, doc, shards)
        yield rows(np.full(len(shard), uid), None, None, None, None, shard, *columns)

    def rows(uid, *columns):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int32(), *[pa.binary()] * 4]
        columns = [*columns, *[None] * (9 - len(columns))]
        return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), *[pa.nulls(len(uid), k) if c is None else c for c, k in zip(columns, kinds, strict=True)]], names=["uid", "doc_id", "lang", "words", "score", "shard", "keys", "size", "docs", "times"])

    return run


def _answer(requests: pa.Table, weights: pa.Table) -> pa.Table:
    """Partial sums of one shard's requests."""
    known = np.concatenate([np.zeros(0, np.uint64), *(expand_sorted(x) for x in weights.column("keys").to_pylist())])
    weight = np.concatenate([np.zeros(0, np.float32), *(expand(x, np.float32) for x in weights.column("weights").to_pylist())])
    known, where = np.unique(known, return_inverse=True)
    table = Lookup(known, np.bincount(where, weight, len(known)))
    uid, total = [], []
    for base, keys, size, docs, times in unpack(requests):
        _, value = table.find(keys)
        sums = np.bincount(docs, np.repeat(value, size) * times)
        at = np.flatnonzero(sums)
        uid.append(base + at)
        total.append(sums[at])
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return pa.table({"uid": pa.array(join(uid, np.int64), pa.int64()), "part": pa.array(join(total, float), pa.float64())})


def classify(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, head: int = 1 << 18, parts: int = 64, shards: int = 64, quantile: float = 0.99, prior: int = 20, group_bytes: int = 1 << 25) -> DataFrame:
    """``(doc_id, lang, n_words, log_prob, perplexity, threshold, trusted, kept)`` for every row of ``docs(doc_id, text, lang)``.

    ``labels(doc_id, quality, toxic)``; ``log_prob`` in natural logs.
    """
    rows = pick(docs, doc_id="long", text="string", lang="string")
    good = written(pick(labels, doc_id="long", quality="int", toxic="int").where("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct())
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)) == 0
    ids = good.where(~held).orderBy(F.xxhash64("doc_id", F.lit(2))).limit(max_docs)
    vocab, word, heads, flags, told = train(rows, ids, head, parts, shards)
    scanned = written(rows.mapInArrow(_scan(vocab, word, heads, flags, shards), PASS))
    asked = scanned.where("shard is not null")
    salts = salts_for(asked, shards, group_bytes)
    sent = asked.select("uid", "shard", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int").alias("salt"), "keys", "size", "docs", "times")
    told = told.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    parts = sent.groupBy("shard", "salt").cogroup(told.groupBy("shard", "salt")).applyInArrow(_answer, "uid long, part double").groupBy("uid").agg(F.sum("part").alias("part"))
    scored = scanned.where("shard is null").join(parts, "uid", "left").withColumn("log_prob", F.col("score") + F.coalesce("part", F.lit(0.0)))
    scored = scored.select("doc_id", "lang", F.col("words").alias("n_words"), "log_prob", F.exp(-F.col("log_prob") / (F.col("words") + 1)).alias("perplexity"))
    scored = written(scored.join(good.withColumn("trusted", F.lit(True)), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False))))
    known = scored.where(F.col("trusted") & held & (F.col("n_words") > 0))
    line = F.ln(F.percentile("perplexity", F.lit(quantile)))
    overall = known.agg(line.alias("t")).first().t
    lines = known.groupBy(F.col("lang").alias("_lang")).agg(line.alias("t"), F.count("*").alias("n"))
    out = scored.join(lines, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    n = F.coalesce("n", F.lit(0))
    line = F.exp((n * F.coalesce("t", F.lit(0.0)) + prior * F.lit(overall).cast("double")) / (n + prior))
    out = out.withColumn("threshold", F.coalesce(line, F.lit(float("inf"))))
    return out.select("doc_id", "lang", "n_words", "log_prob", "perplexity", "threshold", "trusted", ((F.col("n_words") > 0) & (F.col("perplexity") <= F.col("threshold"))).alias("kept"))
