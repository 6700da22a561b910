"""Exact removal of repeated passages by super-k-mer partitioning.

A window is ``size`` consecutive words of one document.  A word goes if a window that covers it has a word
sequence that starts earlier too: in a smaller doc_id, or in the same document at an earlier word.

1.  Each window's minimiser is the smallest hash among its 5-word runs.  Consecutive windows with one
    minimiser travel as a single packed string (a super-k-mer) to the minimiser's partition: about 27 words
    for 8 windows.  Windows repeated within a task's slice are settled there, so a passage that a third of
    all documents share is sent once per slice, not once per document.
2.  Equal windows have equal minimisers, so a run whose minimiser no other run has holds no repeat.  A first pass
    counts minimisers; those found twice fill a bounded Bloom filter, and only runs that it passes are sent.
    A window that a slice of the first pass holds twice counts as two, since the second pass may slice
    the rows elsewhere and part the two.
3.  A partition is sorted by (minimiser, doc_id, start) by Spark, then streamed: windows are unpacked,
    sorted by their 128-bit hashes, and every one but the first is a repeat.  A task holds a bounded piece
    and the distinct windows of one minimiser.  A minimiser that very many runs share (a common phrase with other words around it)
    is split: its windows travel singly, dealt by their own hash.
4.  Repeats come back as word ranges and are joined to their documents; a bounded Bloom filter of the
    documents concerned keeps all other texts out of that shuffle.

Defined results: null or empty text has no words; the digest of no words is that of the empty string; a
null doc_id counts as larger than any other; repeated rows of one doc_id and text tie, so none is the
other's repeat; different texts under one doc_id are documents of their own; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import BlockedBloom, pick, written

RUN = 5
LAST = (1 << 63) - 1
PACKED = "least long, deal long, doc_id long, tag int, start int, stop int, words binary"
RANGES = "doc_id long, tag int, start int, stop int"


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    wide, have = x, 1
    while have * 2 <= n:
        wide = np.minimum(wide[:-have], wide[have:])
        have *= 2
    return np.minimum(wide[: len(x) - n + 1], wide[n - have : n - have + len(x) - n + 1]) if have < n else wide


def joined(words: K.Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The (kept) words, each followed by one space, and the byte offset of each of these words."""
    start, end = (words.start, words.end) if keep is None else (words.start[keep], words.end[keep])
    data = np.append(words.data, np.uint8(32))
    out = K.gather(data, start, end + 1)
    at = np.append(0, np.cumsum(end - start + 1))
    out[at[1:] - 1] = 32
    return out, at


def _repeats(one: np.ndarray, two: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows have an equal one that starts earlier; the input is in any order."""
    again = np.zeros(len(one), bool)
    order = np.argsort(one, kind="stable")
    sorted_one = one[order]
    same = np.zeros(len(one), bool)
    same[1:] = sorted_one[1:] == sorted_one[:-1]
    multi = same.copy()
    multi[:-1] |= same[1:]
    order = order[multi]  # only windows that meet an equal hash need the finer order
    order = order[np.lexsort((start[order], doc[order], two[order], one[order]))]
    if len(order):
        a, b, d, s = one[order], two[order], doc[order], start[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        again[order] = (d != d[lead]) | (s != s[lead])
    return again


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run; ``breaks[i]`` says that i begins one."""
    first = np.flatnonzero(breaks)
    return first, np.append(first[1:], len(breaks)) - 1


def _cut(part: pa.RecordBatch, size: int):
    """The windows of a slice: repeats settled here, and the runs of one minimiser among the others."""
    words = K.split_words(part.column("text"))
    hashes = words.hashes()
    one, at = K.windows(words, hashes, size)
    if not len(at):
        return None
    two, _ = K.windows(words, words.hashes(K.BASES[1]), size, K.WORD_BASES[1])
    ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    text = words.text[at]
    start = at - words.first[text]
    again = _repeats(one, two, ids[text], start)
    gap = np.ones(len(at), bool)
    gap[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
    power, _ = K.powers(K.WORD_BASES[1], RUN)
    run = min(RUN, size)
    grams = np.zeros(len(hashes) - run + 1, np.uint64)
    for j in range(run):
        grams += hashes[j : len(grams) + j] * power[j]
    least = _sliding_min(K.mix64(grams), size - run + 1)[at]

    def runs(held, same_least):
        if not len(held):
            return held, held
        cut = np.ones(len(held), bool)
        cut[1:] = (held[1:] != held[:-1] + 1) | gap[held[1:]]
        if same_least:
            cut[1:] |= least[held[1:]] != least[held[:-1]]
        a, b = _runs(cut)
        return held[a], held[b]

    return words, ids, at, text, start, least, runs(np.flatnonzero(again), False), runs(np.flatnonzero(~again), True)


def _minimisers(size: int):
    """``(least, n)``: how many runs of each minimiser a slice holds, one more for those of windows that repeat in it."""

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, "text"):
                found = _cut(part, size)
                if found:
                    least, (a, b), (c, _) = found[5:]
                    key, n = np.unique(np.append(least[c], np.unique(least[K.ranges(a, b - a + 1)])), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["least", "n"])

    return run


def _pack(size: int, hot: np.ndarray):
    """Runs as packed strings; ``deal`` says where to: by minimiser, but single windows by their hash if it is among the ``hot`` (rising)."""

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, "text"):
                yield from pack(part)

    def pack(part):
        found = _cut(part, size)
        if not found:
            return
        words, ids, at, text, start, least, (a, b), (c, d) = found
        tags = part.column("tag").to_numpy(zero_copy_only=False).astype(np.int32)
        if len(a):  # repeats found here leave as ranges; they need no bucket
            yield rows(None, ids[text[a]], tags[text[a]], start[a], start[b] + size, np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64))
        if len(c):
            deal = least[c]
            if len(hot):
                many = hot[np.minimum(np.searchsorted(hot, deal), len(hot) - 1)] == deal
                single = K.ranges(c[many], d[many] - c[many] + 1)
                one = K.windows(words, words.hashes(), size)[0]
                deal = np.concatenate([deal[~many], K.mix64(least[single] ^ one[single])])
                c, d = np.concatenate([c[~many], single]), np.concatenate([d[~many], single])
            data, where = joined(words)
            begin, end = where[at[c]], where[at[d] + size] - 1
            yield rows((least[c].view(np.int64), deal.view(np.int64)), ids[text[c]], tags[text[c]], start[c], start[d] + size, K.gather(data, begin, end), np.append(0, np.cumsum(end - begin)))

    def rows(least, doc, tag, start, stop, data, offsets):
        dealt = [pa.nulls(len(doc), pa.int64())] * 2 if least is None else [pa.array(x, pa.int64()) for x in least]
        return pa.RecordBatch.from_arrays([*dealt, pa.array(doc, pa.int64()), pa.array(tag, pa.int32()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), K.binary_column(data, offsets)], names=["least", "deal", "doc_id", "tag", "start", "stop", "words"])

    return run


def _count(size: int):
    """Streams rows in (deal, doc_id, start) order and yields the ranges of repeated windows."""

    def run(batches):
        seen = None  # (deal, hashes, second hashes, doc, start) of the last one's distinct windows
        for batch in batches:
            for part in K.slices(batch, "words"):
                local = part.filter(pc.is_null(part.column("deal")))
                if local.num_rows:
                    yield local.select(["doc_id", "tag", "start", "stop"])
                part = part.filter(pc.is_valid(part.column("deal")))
                if part.num_rows:
                    out, seen = piece(part, seen)
                    if out.num_rows:
                        yield out

    def piece(part, seen):
        least, doc, tag, start = (part.column(c).to_numpy(zero_copy_only=False) for c in ("deal", "doc_id", "tag", "start"))
        words = K.split_words(part.column("words").cast(pa.large_binary()).view(pa.large_string()))
        one, at = K.windows(words, words.hashes(), size)
        two, _ = K.windows(words, words.hashes(K.BASES[1]), size, K.WORD_BASES[1])
        row = words.text[at]
        begin = start[row] + (at - words.first[row])
        d = doc[row].astype(np.int64)
        if seen is not None and seen[0] == least[0]:
            k = len(seen[1])
            again = _repeats(np.append(seen[1], one), np.append(seen[2], two), np.append(seen[3], d), np.append(seen[4], begin))[k:]
        else:
            seen, again = None, _repeats(one, two, d, begin)
        tail = (least[row] == least[-1]) & ~again
        fresh = (least[-1], one[tail], two[tail], d[tail], begin[tail])
        if seen is not None and seen[0] == least[-1]:
            fresh = (fresh[0], *(np.append(x, y) for x, y in zip(seen[1:], fresh[1:], strict=True)))
        held = np.flatnonzero(again)
        cut = np.ones(len(held), bool)
        cut[1:] = (held[1:] != held[:-1] + 1) | (row[held[1:]] != row[held[:-1]])
        a, b = _runs(cut) if len(held) else (held, held)
        a, b = held[a], held[b]
        out = pa.RecordBatch.from_arrays([pa.array(d[a], pa.int64()), pa.array(tag[row[a]], pa.int32()), pa.array(begin[a], pa.int32()), pa.array(begin[b] + size, pa.int32())], names=["doc_id", "tag", "start", "stop"])
        return out, fresh

    return run


def _strip(text_out: bool):
    """Applies the ranges of each document to its words."""

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, "text"):
                words = K.split_words(part.column("text"))
                spans = part.column("spans")
                count = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
                flat = spans.flatten()
                text = np.repeat(np.arange(part.num_rows), count)
                begin = words.first[text] + flat.field("start").to_numpy(zero_copy_only=False)
                end = np.minimum(words.first[text] + flat.field("stop").to_numpy(zero_copy_only=False), words.first[text + 1])
                step = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(step, begin, 1)
                np.add.at(step, end, -1)
                keep = np.cumsum(step[:-1]) == 0
                data, at = joined(words, keep)
                left = np.append(0, np.cumsum(keep))[words.first]
                lo, hi = at[left[:-1]], np.maximum(at[left[1:]] - 1, at[left[:-1]])
                view = memoryview(data)
                columns = [part.column("doc_id"), pa.array(words.count, pa.int64()), pa.array(words.count - np.diff(left), pa.int64())]
                names = ["doc_id", "n_words", "n_removed"]
                if text_out:
                    columns.append(K.binary_column(K.gather(data, lo, hi), np.append(0, np.cumsum(hi - lo)), pa.string()))
                else:
                    columns.append(pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.string()))
                names.append("kept_text" if text_out else "kept_sha256")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def repeated_ranges(docs: DataFrame, size: int = 20, hot_runs: int = 2048, most_hot: int = 1 << 17) -> DataFrame:
    """``(doc_id, tag, start, stop)``: word ranges of ``docs(doc_id, tag, text)`` that repeat earlier ones; they may overlap.

    Minimisers with more than ``hot_runs`` runs are hot; of very many, the ``most_hot`` with most runs.
    """
    docs = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST)))
    shared = written(docs.select("doc_id", "text").mapInArrow(_minimisers(size), "least long, n long").groupBy("least").agg(F.sum("n").alias("n")).where("n > 1"))
    bloom = BlockedBloom(shared, "least", shared.count(), max_blocks=1 << 20)
    hot = shared.where(F.col("n") > hot_runs).orderBy(F.desc("n"), "least").limit(most_hot).select("least").toArrow().column("least").to_numpy()
    packed = bloom.maybe(docs.mapInArrow(_pack(size, np.sort(hot.astype(np.int64).view(np.uint64))), PACKED), "least", keep_null=True)
    # rows without a minimiser are settled ranges; they are dealt by document
    dealt = packed.repartition(F.coalesce("deal", F.xxhash64("doc_id"))).sortWithinPartitions("deal", "doc_id", "start")
    return dealt.mapInArrow(_count(size), RANGES)


def remove_repeats(docs: DataFrame, size: int = 20, text_out: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` per row, or ``kept_text`` (words joined by one space) for the digest."""
    docs = pick(docs, doc_id="long", text="string").withColumn("tag", F.hash("text"))
    schema = f"doc_id long, n_words long, n_removed long, {'kept_text' if text_out else 'kept_sha256'} string"
    return _applied(docs, size).mapInArrow(_strip(text_out), schema)


def _applied(docs: DataFrame, size: int) -> DataFrame:
    """The documents with their ranges; those surely without any take no part in the join."""
    found = written(repeated_ranges(docs.select("doc_id", "tag", "text"), size))
    spans = found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    keys = found.select(F.xxhash64("doc_id", "tag").alias("key")).distinct()
    bloom = BlockedBloom(keys, "key", keys.count())
    keyed = docs.withColumn("_id", F.coalesce("doc_id", F.lit(LAST))).withColumn("_key", F.xxhash64("_id", "tag"))
    near, far = bloom.maybe(keyed, "_key"), bloom.surely_not(keyed, "_key")
    spans = spans.toDF("_doc", "_tag", "spans")
    near = near.join(spans, (F.col("_id") == F.col("_doc")) & (F.col("tag") == F.col("_tag")), "left").select(*docs.columns, "spans")
    return near.unionByName(far.select(*docs.columns, F.lit(None).cast("array<struct<start:int,stop:int>>").alias("spans")))


def _strip_text(batches):
    """Cuts the ranges' words, each with the white space behind it, out of the text; other columns pass."""
    for batch in batches:
        for part in K.slices(batch, "text"):
            words = K.split_words(part.column("text"))
            n, size = part.num_rows, len(words.data)
            spans = part.column("spans")
            count = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
            flat = spans.flatten()
            text = np.repeat(np.arange(n), count)
            begin = words.first[text] + flat.field("start").to_numpy(zero_copy_only=False)
            end = np.minimum(words.first[text] + flat.field("stop").to_numpy(zero_copy_only=False), words.first[text + 1])
            step = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(step, begin, 1)
            np.add.at(step, end, -1)
            gone = np.flatnonzero(np.cumsum(step[:-1]) > 0)
            lo = words.start[gone]
            hi = np.minimum(np.append(words.start, size)[gone + 1], words.offsets[words.text[gone] + 1])
            level = np.zeros(size + 1, np.int64)
            np.add.at(level, lo, 1)
            np.add.at(level, hi, -1)
            keep = np.cumsum(level[:-1]) == 0
            at = np.append(0, np.cumsum(keep))[words.offsets]
            new = K.binary_column(words.data[keep], at, pa.string())
            removed = np.bincount(words.text[gone], minlength=n)
            untouched = pa.array(removed == 0)
            columns = [pc.if_else(untouched, part.column("text"), new) if c == "text" else part.column(c) for c in part.schema.names if c != "spans"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words.count - removed), pa.array(removed)], names=[*(c for c in part.schema.names if c != "spans"), "n_left", "n_removed"])


def strip_texts(docs: DataFrame, size: int = 20) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and the columns ``n_left`` and ``n_removed`` (words).

    All columns of ``docs`` stay; texts without a repeat stay as they are, white space included.
    """
    # inside, the other columns have names of their own, so that none of theirs can clash
    names = docs.columns
    where = {n: names.index(n) for n in ("doc_id", "text")}
    inner = [next((n for n, i in where.items() if i == j), f"c{j}") for j in range(len(names))]
    tagged = docs.toDF(*inner).withColumns({"doc_id": F.col("doc_id").cast("long"), "tag": F.hash("text")})
    applied = _applied(tagged, size)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tagged.schema)
    cut = applied.mapInArrow(_strip_text, f"{kinds}, n_left long, n_removed long").drop("tag")
    return cut.toDF(*names, "n_left", "n_removed")
